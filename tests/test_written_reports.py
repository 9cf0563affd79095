from loamline.operators import report


def test_reports_of_replies(spark):
    replies = [
        (1, '{"summary": " s ", "key_flows": [{"text": " a ", "citations": ["x.py", {"path": "y.py", "line": 2}, {"path": 5}, {"path": "z.py", "line": "3", "end_line": 4}, null]}, {"text": 1}, {}, null, {"text": "b"}]}'),
        (2, 'short {"summary": "one"} long {"summary": "two", "dependencies": [{"text": "d"}]}'),
        (3, "nothing"), (4, None), (5, "[1, 2]"), (6, '{"dependencies": {"text": "no list"}}'), (7, '{"tech_stack": [{"text": "said "so" here"}]}'),
    ]
    reports, claims = report.parsed_reports(spark.createDataFrame(replies, "report_id int, reply string"))
    assert {(r.report_id, r.summary, r.n_claims) for r in reports.collect()} == {(1, "s", 2), (2, "two", 1), (6, "", 0), (7, "", 1)}
    got = {(r.report_id, r.section, r.nth, r.text): [tuple(c) for c in r.citations] for r in claims.collect()}
    assert got == {
        (1, "key_flows", 0, "a"): [("x.py", None, None), ("y.py", 2, None), ("z.py", None, 4)],
        (1, "key_flows", 4, "b"): [],
        (2, "dependencies", 0, "d"): [],
        (7, "tech_stack", 0, 'said "so" here'): [],
    }
    assert report.parsed_reports(spark.createDataFrame([], "report_id int, reply string"))[0].collect() == []
