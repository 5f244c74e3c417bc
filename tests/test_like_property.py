"""Property: the LIKE -> regex rewrite agrees with a direct LIKE matcher."""
from functools import lru_cache

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.functions.text import like_to_regex


def like(name: str, pattern: str) -> bool:
    """Brute-force case-insensitive LIKE: % any run, _ one character, [..] / [^..] classes."""
    name, pattern = name.lower(), pattern.lower()
    tokens, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        j = pattern.find("]", i + 1) if c == "[" else -1
        if c == "[" and j > i + 1:
            body = pattern[i + 1:j]
            neg = body.startswith("^")
            tokens.append(("class", set(body[1:] if neg else body), neg))
            i = j + 1
        else:
            tokens.append(("char", c, False))
            i += 1

    @lru_cache(maxsize=None)
    def m(a: int, b: int) -> bool:
        if b == len(tokens):
            return a == len(name)
        kind, val, neg = tokens[b]
        if kind == "char" and val == "%":
            return any(m(k, b + 1) for k in range(a, len(name) + 1))
        if a == len(name):
            return False
        ch = name[a]
        if kind == "class":
            ok = (ch in val) != neg
        else:
            ok = val == "_" or val == ch
        return ok and m(a + 1, b + 1)

    return m(0, 0)


ALPHA = "abAB_%.[]^*+&"
cases = st.lists(st.tuples(st.text(alphabet=ALPHA, max_size=6), st.text(alphabet="abAB.[]^*+_%&", max_size=6)),
                 min_size=50, max_size=200)


@settings(max_examples=10, deadline=None)
@given(cases)
def test_like_rewrite_matches_brute_force(spark, pairs):
    df = spark.createDataFrame(pairs, "pattern string, name string")
    rows = df.select("pattern", "name", F.regexp_like("name", like_to_regex("pattern")).alias("got")).collect()
    for r in rows:
        assert r.got == like(r.name, r.pattern), (r.pattern, r.name)
