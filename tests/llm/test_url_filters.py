import random
import re

from tidewake.llm import url_filters as u
from tidewake.llm.textnum import raw


def regex(glob):
    return re.compile("".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.findall(r"\*\*|\*|[^*]+", glob)), re.S)


def test_automaton_equals_regular_expressions():
    import pyarrow as pa

    rng = random.Random(0)
    for _ in range(60):
        globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "é"]) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 30))]
        texts = ["".join(rng.choice("ab/é") for _ in range(rng.randint(0, 9))) for _ in range(40)]
        got = u.ShiftAnd(globs).matches(*raw(pa.array(texts)))
        assert got.tolist() == [[bool(regex(g).fullmatch(t)) for g in globs] for t in texts]


def test_verdicts(spark):
    cases = {
        "http://x.com/en/1": ("x.com", "/en/1", "com/en/", "block"),
        "http://EXAMPLE.com/en/71?q": ("example.com", "/en/71", "example.com/en/7", "allow"),
        "https://notcom/en/": ("notcom", "/en/", None, "allow"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://b.example.net/de/8#x": ("b.example.net", "/de/8", "example.net/de/8", "block"),
        "http://q.net/de/": ("q.net", "/de/", "net/de/", "allow"),
        "http://q.org?/es/": ("q.org", "", None, "allow"),
        "http://a.org/x.com/en/": ("a.org", "/x.com/en/", None, "allow"),
        "http://a.org/cgi-bin/q": ("a.org", "/cgi-bin/q", None, "block"),
        "http://a.org/b.EXE": ("a.org", "/b.EXE", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://" + "x" * 5000 + ".org/es/": ("x" * 5000 + ".org", "/es/", "org/es/", "block"),
    }
    keys = list(cases)
    df = spark.createDataFrame([(k, v, "z") for k, v in enumerate(keys)] + [(0, keys[0], "z")], "page_id long, url string, host string")
    rows = u.filter_urls(df).collect()
    assert len(rows) == len(keys) + 1
    assert {keys[r.page_id]: (r.host, r.path, r.rule, r.verdict) for r in rows} == cases
    assert u.filter_urls(df.limit(0)).count() == 0
