import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import url_filter
from tessera.llm.url_filter import Automaton, Rule

ALPHABET = "ab./é*?-"


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "(?s:.*)", i + 2
            continue
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return re.compile(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET + "\\", max_size=8), min_size=1, max_size=30), st.lists(st.text(ALPHABET, max_size=12), max_size=8))
def test_automaton_is_the_globs(globs, texts):
    want = [[bool(as_regex(g).fullmatch(t)) for g in globs] for t in texts]
    assert Automaton(globs).matches([t.encode() for t in texts]).tolist() == want


def test_globs_wider_than_a_word():
    glob = "a" * 200 + "*" + "b" * 100
    hits = Automaton(["x", glob]).matches([b"a" * 200 + b"zz" + b"b" * 100, b"a" * 199 + b"b" * 100, b""])
    assert hits[:, 1].tolist() == [True, False, False]


def test_rules_and_odd_urls(spark):
    urls = [
        "http://www.example.com/en/1", "http://WWW.Example.COM/en/1", "http://a.example.com/en/", "https://b.com/fr?x", "http://com/",
        "http://evil.org/x.example.com/en/", "http://example.com.net/es/", "http://free-bets.example.net/de/1", "no url", None, "",
        "://", "http://notexample.com/en/", "http://com", "a://b://net/es/x", "http://x.net/es/" + "y" * 100_000, "http://y.org/a*b",
    ]
    rows = [(i, u, "h", "p", "r", "v", "c") for i, u in enumerate(urls)] + [(None, urls[0], "h", "p", "r", "v", "c")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string, code string")
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.rule, r.verdict) for r in got if r.page_id is not None}
    assert by[0] == by[1] == ("www.example.com", "www.example.com/en/", "allow")
    assert by[2][1:] == ("example.com/en/", "block")
    assert by[3][1:] == by[4][1:] == ("com/", "allow")
    assert by[5] == ("evil.org", None, "allow")
    assert by[6][1:] == ("net/es/", "block")
    assert by[7][1:] == (None, "block")
    assert by[8] == by[9] == by[10] == by[11] == ("", None, "allow")
    assert by[12][1:] == ("com/", "allow")
    assert by[13] == ("com", None, "allow")
    assert by[14] == ("b:", None, "allow")
    assert by[15][1:] == ("net/es/", "block")
    assert sum(r.page_id is None and r.verdict == "allow" for r in got) == 2
    assert url_filter.judge(df.limit(0)).collect() == []


def test_wildcards_in_rules_are_plain_signs(spark):
    df = spark.createDataFrame([(1, "http://h.org/a*b"), (2, "http://h.org/axb")], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.judge(df, rules=[Rule("h.org", "/a*b", False)], block_hosts=[]).collect()}
    assert got == {1: "h.org/a*b", 2: None}
    assert {r.verdict for r in url_filter.judge(df, rules=[], block_hosts=[]).collect()} == {"allow"}
