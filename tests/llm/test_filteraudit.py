import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lectern.llm import filteraudit
from tests.llm.helpers import prose

DOCS = "doc_id long, text string, lang string, `a.b` int, mask string"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    """Every row against every order, by the wording of the conditions."""
    texts = [(i, t or "", lang or "") for i, t, lang, *_ in docs]
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x, _ in labels if x == 1 and i is not None}
    rows = []
    for i, t, part in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and t == u for j, u, _ in texts)
        rows.append((part, fails, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                shapley[part, x] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), sum(r[1][x] for r in mine) - len(gone), sum(r[1][x] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def corpus():
    r = random.Random(5)
    long = [" ".join(f"{w}{k}" for k, w in enumerate(prose(s, 130).split())) for s in range(6)]
    texts = [None, "", " \t\n", "Short text", "SHOUTING", "a b  c", "money $ here", *long, long[0] + " #", long[1].upper(), prose(9, 160), "x " * 300, "é" * 90 + "ABCDEFGHIJK", "😀 " * 150]
    docs = [(r.choice([None, *range(60)]), r.choice(texts), r.choice(["en", "de", "", None, "xx"]), 1, "m") for _ in range(300)]
    docs += docs[:20] + [(i, long[2], "en", 1, "m") for i in range(100, 160)]
    labels = [(r.choice([None, *range(70)]), r.choice([None, 0, 1]), r.choice([None, 0, 1]), "p") for _ in range(90)]
    return docs, labels


@pytest.mark.parametrize("fingerprint, most", [(None, filteraudit.MOST_BYTES), ("one", filteraudit.MOST_BYTES), ("few", 2000)])
def test_report_equals_brute_force(spark, fingerprint, most):
    """Also with fingerprints that collide, and with chains handed on early."""
    docs, labels = corpus()
    key = {"one": F.lit(7).cast("long"), "few": F.length("text").cast("long") % 3}.get(fingerprint)
    found = filteraudit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS), key, most)
    assert found.columns == [x.split()[0] for x in filteraudit.REPORT.split(", ")]
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = corpus()
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filteraudit.audit(none[0], spark.createDataFrame(labels, LABELS)).count() == 0
    found = filteraudit.audit(spark.createDataFrame(docs, DOCS), none[1])
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, [])


def test_long_texts_are_counted_like_short_ones(monkeypatch):
    for text in ("a b " * 300, "one\x0btwo\x1cthree four " * 40, "x" * 5000, ""):
        whole = filteraudit.failures(text.encode(), len(text))
        with monkeypatch.context() as m:
            m.setattr(filteraudit, "LONG_TEXT", -1)
            assert filteraudit.failures(text.encode(), len(text)) == whole


def test_a_shared_text_is_sent_once_a_task(spark):
    rows = [(i, "en", bytearray(b"same text"), 9, 42) for i in range(1000, 0, -1)]
    sent = list(filteraudit._route(filteraudit.MOST_BYTES)(iter(rows)))
    assert len([v for _, v in sent if isinstance(v, list)]) == 1 and len(sent) == 1000
