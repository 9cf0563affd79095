import datetime as dt

from pyspark.sql import functions as F

from loamline.llm import url_lists as U

D = dt.date
ENTRIES = "list string, kind string, value string, action string, dated date"
CAPTURES = "page_id long, url string, fetched_on date"


def judge(spark, captures, entries, more=False):
    caps = spark.createDataFrame(captures, CAPTURES)
    if more:
        caps = caps.withColumns({"host": F.lit("x"), "list": F.lit(1), "key": F.lit(2), "times": F.lit(3), "n_active": F.lit(4)})
    return U.judge(caps, spark.createDataFrame(entries, ENTRIES)).collect()


def test_validity_intervals(spark):
    rows = [("a", "domain", "x.org", "add", D(2024, 1, 1)), ("a", "domain", "x.org", "remove", D(2024, 2, 1)), ("a", "domain", "x.org", "add", D(2024, 3, 1)), ("a", "domain", "x.org", "add", D(2024, 4, 1)), ("b", "domain", "x.org", "remove", D(2024, 1, 1)), ("b", "domain", "y.org", "add", D(2024, 1, 5)), ("b", "domain", "y.org", "remove", D(2024, 1, 5)), (None, "domain", "z", "add", D(2024, 1, 1))]
    got = sorted((r.list, r.key, r.since, r.until) for r in U.validity(spark.createDataFrame(rows + rows[:2], ENTRIES)).collect() if r.until)
    assert got == [("a", "domain x.org", D(2024, 1, 1), D(2024, 2, 1)), ("a", "domain x.org", D(2024, 3, 1), D(2024, 4, 1))]
    assert U.validity(spark.createDataFrame(rows, ENTRIES)).where("until is null").count() == 1


def test_as_of_boundaries_and_precedence(spark):
    entries = [("spam", "domain", "x.org", "add", D(2024, 1, 10)), ("spam", "domain", "x.org", "remove", D(2024, 1, 20)), ("porn", "prefix", "a.x.org/p/", "add", D(2024, 1, 1)), ("porn", "url", "https://a.x.org/p/q", "add", D(2024, 1, 15)), ("ads", "url", "https://a.x.org/p/q", "add", D(2024, 1, 15))]
    url = "https://User@A.X.org:8080/p/q"
    days = {d: ("https://a.x.org/p/q#top", D(2024, 1, d)) for d in (9, 10, 14, 15, 19, 20)}
    out = {r.page_id: r for r in judge(spark, [(d, *v) for d, v in days.items()] + [(1, url, D(2024, 1, 12)), (2, "https://notx.org/", D(2024, 1, 12)), (3, "https://x.org.evil.com/p/", D(2024, 1, 12))], entries)}
    assert [out[d].n_active for d in days] == [1, 2, 2, 4, 4, 3]
    assert out[9].matched == "prefix a.x.org/p/" and out[10].list == "porn" and out[15].matched == "url https://a.x.org/p/q" and out[15].list == "ads"
    assert out[1].host == "a.x.org" and out[1].n_active == 2
    assert not out[2].blocked and not out[3].blocked


def test_awkward_captures(spark):
    entries = [("l", "domain", "x.org", "add", D(2024, 1, 1))]
    caps = [(1, None, D(2024, 2, 1)), (None, "http://x.org", D(2024, 2, 1)), (2, "http://x.org", None), (3, "", D(2024, 2, 1)), (4, "no url", D(2024, 2, 1)), (5, "http://x.org/" + "a/" * 300, D(2024, 2, 1)), (6, "http://x.org", D(2024, 2, 1)), (6, "http://x.org", D(2024, 2, 1))]
    out = judge(spark, caps, entries, more=True)
    assert len(out) == len(caps)
    assert sorted((r.page_id or 0) for r in out if r.blocked) == [0, 5, 6, 6]
    assert judge(spark, [], entries) == []
    assert not any(r.blocked for r in judge(spark, caps, []))


def test_no_python_in_the_plan(spark):
    caps, entries = spark.createDataFrame([(1, "http://x.org", D(2024, 2, 1))], CAPTURES), spark.createDataFrame([("l", "domain", "x.org", "add", D(2024, 1, 1))], ENTRIES)
    plan = U.judge(caps, entries)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
