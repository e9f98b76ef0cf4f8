"""URL filters against string comparisons with every rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.llm import urls
from foliant.llm.queries import URL_RULES

UPPER, LOWER = urls.UPPER, urls.LOWER


def by_hand(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0].translate(str.maketrans(UPPER, LOWER))
        path = re.match("[^/?#]*([^?#]*)", rest)[1]
    fits = []
    for h, p, v in rules:
        if h is not None and v is not None:
            h, p = h.translate(str.maketrans(UPPER, LOWER)), p or ""
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(h) + len(p), len(h), v == "block", h + p, v))
    best = max(fits) if fits else (0, 0, False, None, default)
    return host, path, best[3], best[4], len(set(fits))


ODD = [
    None, "", "no scheme", "http://", "http:///path", "https://EXAMPLE.Net/en/x", "https://example.net/en", "https://example.net", "http://net/", "http://.net/", "http://a..net/x", "http://example.net./en/", "http://notexample.net/en/",
    "http://user@example.com:80/de/", "http://example.com/de/?q", "http://example.com?/de/", "http://example.com#/de/", "http://x.org/fr/a/b/c", "http://x.org//fr/", "a://b://example.net/en/", "http://É.example.NET/EN/", "http://a\nb.net/c\nd", "http://" + "a." * 3000 + "net/" + "x/" * 3000,
]


def rows_of(df):
    return sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict, r.n_rules) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bound", [urls.BROADCAST_BYTES, 0])
def test_rules(spark, bound):
    """Broadcast and shuffled joins give the same; repeated rows, null keys and columns with clashing names do no harm."""
    rng = random.Random(4)
    label, step = ["a", "b", "net", "org", "example", ""], ["en", "fr", "e", "", "x.html"]

    def host():
        return ".".join(rng.choices(label, k=rng.randint(1, 4)))

    def path():
        return "".join("/" + s for s in rng.choices(step, k=rng.randint(0, 3)))

    rules = URL_RULES + [(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)] + [("NET", None, "block"), ("net", "/e", "allow"), (None, "/", "block"), ("a.b", "/", None), ("a.b", "/en/", "allow"), ("a.b", "/en/", "block")]
    found = ODD + [f"https://{host()}{path()}" for _ in range(300)]
    pages = [(i, u) for i, u in enumerate(found)] + [(3, found[3])] * 3 + [(None, found[40])] * 2
    table = spark.createDataFrame(pages, "page_id long, url string").repartition(5)
    for name in ("host", "path", "rule", "key", "n", "of", "short", "digest"):
        table = table.withColumn(name, F.lit(name))
    held = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = rows_of(urls.judged(table, held, broadcast_bytes=bound))
    assert got == sorted(((i, u, *by_hand(u, rules)) for i, u in pages), key=repr)


def test_one_shuffle(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    held = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    plan = urls.judged(pages, held)._jdf.queryExecution().executedPlan().toString()
    # rows once; the others make the rules distinct and broadcast them
    assert plan.count("Exchange hashpartitioning(key") == 1 and "Python" not in plan and "html" not in plan


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {r.page_id: (r.host, r.rule, r.verdict) for r in urls.judged(pages, none, default="block").collect()} == {1: ("a.net", None, "block"), 2: ("", None, "block")}
    assert urls.judged(pages.where("page_id > 5"), spark.createDataFrame(URL_RULES, none.schema)).count() == 0
