import random
import re

from pyspark.sql import functions as F

from tallyframe.llm import url_filters as u


def plain(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    return (lower(found[1]), found[2]) if found else ("", "")


def test_random_rules_match_brute_force(spark):
    rng = random.Random(3)
    labels, segments = ["com", "net", "Example", "www", "a", "b", "", "x-y"], ["en", "fr", "", "e", "x?y", "#z", "é", "en/\nq"]
    urls = [(i, rng.choice(["http://", "HTTP://", "", "://", "a://b://"]) + ".".join(rng.choice(labels) for _ in range(rng.randint(0, 4)))
             + "/".join(["", *(rng.choice(segments) for _ in range(rng.randint(0, 3)))])) for i in range(1500)]
    urls += [(5000, None), (5001, ""), (None, "http://com/"), (None, None), (7, "http://com/"), (7, "http://com/")]
    rules = {}
    for _ in range(50):
        key = ".".join(rng.choice(["com", "net", "example", "www", "a", "b"]) for _ in range(rng.randint(1, 3))), "/" + rng.choice(["", "en", "e", "en/", "fr"])
        rules.setdefault(key, rng.choice(["allow", "block"]))
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns(
        {"host": F.lit("clash"), "rule": F.lit(1), "key": F.lit(2), "part": F.lit(3), "piece": F.lit(4)})
    got = u.judge_urls(pages, [(v, h, p) for (h, p), v in rules.items()]).collect()
    assert len(got) == len(urls)
    by_url = {}
    for r in got:
        assert (r.key, r.part, r.piece) == (2, 3, 4)
        by_url[r.url] = r
    for _, url in urls:
        host, path = plain(url)
        fits = {h + p: v for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)}
        r = by_url[url]
        assert (r.host, r.path) == (host, path)
        if fits:
            assert len(r.rule) == max(map(len, fits)) and fits[r.rule] == r.verdict
        else:
            assert r.rule is None and r.verdict == "allow"


def test_stack_of_nested_rules():
    pieces = u.rule_pieces([("allow", "com", "/"), ("block", "com", "/a/"), ("allow", "com", "/a/b/")])
    verdict = lambda key: next((v for k, _, v, _ in reversed(pieces) if k <= key), None)
    key = lambda path: f"com.\x00{path}".encode()
    assert [verdict(key(p)) for p in ("", "/", "/a", "/a/", "/a/b", "/a/b/c", "/a/c", "/b")] == [
        None, "allow", "allow", "block", "block", "allow", "block", "allow"]


def test_no_rules_and_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert u.judge_urls(empty, [("allow", "com", "/")]).count() == 0
    row = u.judge_urls(spark.createDataFrame([(1, "http://A.com/x")], "page_id long, url string"), []).first()
    assert (row.host, row.path, row.rule, row.verdict) == ("a.com", "/x", None, "allow")


def test_main_path_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = u.judge_urls(pages, [("block", "com", "/")])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
