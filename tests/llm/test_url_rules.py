"""The verdict of each rule in the contract of op8, written out here apart from the code's own list."""

import pandas as pd

from lastrum.llm import url_filter
from lastrum.llm.queries import QUERIES

WORDS = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def wanted(url):
    rest = (url or "").partition("://")[2]
    host, slash, path = rest.partition("/")
    fits = [r for r in WORDS for h, _, p in [r.partition("/")] if ("." + host).endswith("." + h) and (slash + path).startswith("/" + p)]
    rule = max(fits, key=len, default=None)
    return rule, WORDS.get(rule, "allow")


def test_each_rule_says_what_the_contract_says(spark, tmp_path):
    urls = [f"http://{sub}{rule}{tail}" for rule in WORDS for sub in ("", "www.", "a.b.") for tail in ("", "x/y", "?q")]
    urls += ["http://example.net/de/7", "http://example.com/en/8", "http://xnet/de/", "http://net/d", "net/de/", None]
    pd.DataFrame({"page_id": range(len(urls)), "url": urls}).to_parquet(f"{tmp_path}/pages.parquet")
    for got in (QUERIES["op8_url_filter"](spark, str(tmp_path)), url_filter.judge(spark.read.parquet(f"{tmp_path}/pages.parquet"), url_filter.entries(spark))):
        assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == dict(enumerate(map(wanted, urls)))
