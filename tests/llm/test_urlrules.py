import math
import random
import re
import string
from collections import Counter
from itertools import combinations

import pytest

from lectern.llm import urlrules
from lectern.llm.queries.op11 import RULES

PAGES = "page_id long, url string, tokens int, rule string, `a.b` int, Host string"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    name = re.match(r"[^/?#]*", rest)[0]
    return rest, name.translate(LOW), re.match(r"[^?#]*", rest[len(name) :])[0]


def token_set(url):
    rest, name, path = parts(url)
    fold = lambda x: re.sub("[0-9]+", "#", x)
    labels = name.split(".")
    found = {f"h{i}={x}" for i, x in enumerate(reversed(labels)) if x} | {f"w={w}" for x in labels if "-" in x for w in x.split("-") if w}
    found |= {f"p={fold(x)}" for x in path.split("/") if x}
    query = re.match(r"[^?#]*\?([^#]*)", rest)
    found |= {f"q={fold(k)}" for k in (x.split("=", 1)[0] for x in (query[1] if query else "").split("&")) if k}
    return sorted(found | ({f"f={fold(rest.split('#')[1])}"} if "#" in rest else set()))


def longest(url, rules):
    _, name, path = parts(url)
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (name == h or name.endswith(f".{h}")) and path.startswith(p)]
    return (max(fit)[3], max(fit)[2]) if fit else (None, None)


def brute(pages, rules, labels=None, support=urlrules.SUPPORT):
    """Counts all combinations of up to three tokens."""
    known = [(token_set(u), v) for u, v in (labels if labels is not None else [(p[1], longest(p[1], rules)[1]) for p in pages]) if v is not None]
    floor = max(urlrules.LEAST_ROWS, math.ceil(support * len(known)))
    share = Counter(t for ts, _ in known for t in ts)
    counts, totals = Counter(), Counter()
    for ts, v in known:
        ts = [t for t in ts if floor <= share[t] <= urlrules.MOST_SHARE * len(known)]
        for items in (c for k in (1, 2, 3) for c in combinations(ts, k)):
            counts[items, v] += 1
            totals[items] += 1
    mined = [(-n / totals[i], -n, len(i), " ".join(i), v, set(i)) for (i, v), n in counts.items() if n >= floor and n / totals[i] >= urlrules.CONFIDENCE]
    top = min(((-n, v) for v, n in Counter(v for _, v in known).items()), default=(0, urlrules.ALLOW))[1]
    out = []
    for page_id, url, *_ in pages:
        rule, verdict = longest(url, rules)
        best = min((m for m in mined if m[5] <= set(token_set(url))), default=None) if verdict is None else None
        out.append((page_id, *parts(url)[1:], rule, verdict or (best[4] if best else top), -best[0] if best else None, best[3] if best else None))
    return sorted(out, key=repr)


def made(n=500):
    r = random.Random(3)
    hosts = ["www.good.example.org", "m.bad-pills.example.com", "Blog.Other.EXAMPLE.net", "x-y-.example.org", "example.org", "notexample.org", "a..b.com", "org", "hot.example.net"]
    tails = ["/es/12", "/en/15", "/en/2", "/fr/3?page=2&ref=x&&=1", "/de/77.html#top", "", "?q", "#f1", "/de/", "//fr/1", "/en/1/../2?u=http://x.org/"]
    odd = [None, "", "no scheme", "://", "http://", "http:///path", "mailto://a@b.com:80/fr/x y", "x://y://z/de/1", "HTTP://ÄÖ.example.org/ü\n/1", "http://" + "long" * 3000 + ".org/" + "a/" * 2000]
    pages = [(k, f"http{r.choice(['', 's'])}://{r.choice([*hosts, 'hot.example.net'])}{r.choice(tails)}", 1, "x", 2, "h") for k in range(n)]
    return pages + [(r.choice([None, k]), u, 1, "x", 2, "h") for k, u in enumerate(odd)] + pages[:9]


def rows(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_verdicts_equal_counting_everything(spark):
    pages = made()
    found = urlrules.judge(spark.createDataFrame(pages, PAGES), RULES)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "confidence", "because"]
    assert rows(found) == brute(pages, RULES)


def test_labels_of_their_own_and_support(spark):
    pages = made(200)
    labels = [(u, None if k % 7 == 0 else "block" if "pills" in u or k % 11 == 0 else "allow") for k, (_, u, *_) in enumerate(pages) if u]
    found = urlrules.judge(spark.createDataFrame(pages, PAGES), RULES, labels=spark.createDataFrame(labels, "url string, label string"), support=0.05)
    assert rows(found) == brute(pages, RULES, labels, 0.05)


@pytest.mark.parametrize("as_table", [True, False])
def test_many_rules_are_joined_with_the_same_result(spark, as_table, monkeypatch):
    pages = made(200)
    rules = [*RULES, ("org", "", "block"), ("hot.example.net", "/en/1/", "block"), ("", "/", "block"), ("net", "/en/", "allow")]
    direct = rows(urlrules.judge(spark.createDataFrame(pages, PAGES), rules))
    monkeypatch.setattr(urlrules, "MOST_LISTED", 0)
    table = spark.createDataFrame(rules, "host string, path string, verdict string") if as_table else rules
    assert rows(urlrules.judge(spark.createDataFrame(pages, PAGES), table)) == direct == brute(pages, rules)


def test_empty_tables_and_no_rules(spark):
    pages = made(30)
    assert rows(urlrules.judge(spark.createDataFrame([], PAGES), RULES)) == []
    assert rows(urlrules.judge(spark.createDataFrame(pages, PAGES), [])) == brute(pages, [])
    assert {r.verdict for r in urlrules.judge(spark.createDataFrame(pages, PAGES), []).collect()} == {urlrules.ALLOW}


def test_no_python_in_the_plan(spark):
    plan = urlrules.judge(spark.createDataFrame(made(50), PAGES), RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
