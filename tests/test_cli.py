import json

from lectern.__main__ import main
from tests.test_chunking import raw_pages


def test_from_pages_to_evaluation(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "RFC 77.txt").write_text("\n%%PAGE%%\n".join(raw_pages()))
    main(["chunk", str(tmp_path / "in"), str(tmp_path / "out")])
    assert "naive 1" in capsys.readouterr().out
    main(["ingest", str(tmp_path / "out/naive"), "--name", "cli_chunks"])
    assert "1 1" in capsys.readouterr().out
    main(["search", "cli_chunks", "case", "--filter", "rfc == 77"])
    assert "naive-77-0000" in capsys.readouterr().out
    rows = [{"id": "q1", "question": "What is insensitive?", "evidence": "case-insensitive text.", "answerable": True}, {"id": "q2", "question": "?", "answerable": False}]
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    main(["evaluate", str(tmp_path / "out/naive"), str(tmp_path / "q.jsonl"), str(tmp_path / "report")])
    assert json.loads(next((tmp_path / "report").glob("*.json")).read_text().splitlines()[0])["recall_1"] == 1.0
    capsys.readouterr()
    main(["ingest", str(tmp_path / "out/naive"), "--name", "cli_chunks", "--cache", str(tmp_path / "cache")])
    main(["hybrid", str(tmp_path / "out/naive"), str(tmp_path / "q.jsonl"), str(tmp_path / "report"), "--name", "cli_chunks"])
    out = capsys.readouterr().out
    assert "vector        1.000    1.000    1.000    1.000" in out and "hybrid        1.000" in out and "words         1.000" in out
    for _ in range(2):  # the second run finds everything answered
        main(["benchmark", str(tmp_path / "q.jsonl"), str(tmp_path / "run"), "--configs", "notools,rag,agent", "--name", "cli_chunks"])
        out = capsys.readouterr().out
        assert "notools" in out and "rag" in out and "agent" in out
    log = [json.loads(x) for f in (tmp_path / "run/log").glob("*.json") for x in f.read_text().splitlines()]
    answers = {(r["config"], r["qid"]): r for r in log}
    assert answers["rag", "q1"]["answer"] == answers["agent", "q1"]["answer"] == "[1] RFC 77 · стр. 3" and answers["rag", "q1"]["chunk_ids"] == ["naive-77-0000"]
    assert answers["agent", "q2"]["steps"] == 2 and json.loads(answers["agent", "q2"]["tool_calls"][0]) == {"query": "?"} and answers["notools", "q2"]["answer"] == "?"
    assert all(r["verdict"] in (None, "wrong") for r in log)
    main(["report", str(tmp_path / "run/log")])
    assert "notools" in capsys.readouterr().out
    (tmp_path / "messages").mkdir()
    (tmp_path / "messages" / "m.json").write_text('{"chat_id": 1, "seq": 1, "t": 0.0, "text": "hello"}\n{"chat_id": 1, "seq": 2, "t": 1.0, "text": "/start"}\n')
    main(["serve", str(tmp_path / "messages"), str(tmp_path / "service")])
    assert "hello" in capsys.readouterr().out
    spark.sql("DROP TABLE cli_chunks")
