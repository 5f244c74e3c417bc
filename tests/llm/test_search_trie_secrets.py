"""Lexical search, prefix trie and secret scan against brute force, and on awkward inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import credentials, search, trie

random.seed(9)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6))) for _ in range(400)]
DOCS = "doc_id long, text string, n long, score double, rank int, terms string, query int"


def prose(n: int) -> str:
    return " ".join(random.choices(WORDS, k=n))


def docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2.0, 3, "x", 4) for d, t in rows], DOCS)


# ------------------------------------------------------------------ 11

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return Counter(TERM.findall(low))


def brute_search(rows, items, top=20):
    counts = [(d, terms_of(t)) for d, t in rows]
    held = [(d, c) for d, c in counts if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in {(i, t or "") for i, t in items}:
        q, found = terms_of(text), []
        for d, c in held:
            m = 75 + (25 * sum(c.values()) * n) // length
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, k in q.items() if c[t])
            if score > 0:
                found.append((-score, d is None, d, score))
        for i, (_, _, d, score) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top]):
            out[item, i + 1, d, score] += 1
    return out


SEARCH_ROWS = ([(i, prose(random.randint(1, 120))) for i in range(300)] + [(500 + i, "same text again abc") for i in range(40)]
               + [(None, "same text again abc"), (None, None), (7, None), (8, ""), (9, "..,\n\t"), (10, prose(9000)), (11, "Éé x\u0000y 中文 Zz"), (11, "Éé x\u0000y 中文 Zz")])
ITEMS = ([(i, prose(12)) for i in range(25)] + [(100, "SAME same text"), (101, None), (102, ""), (103, "nothing here zzzzzz"), (104, "Éé 中文"), (104, "Éé 中文"),
         (105, "abc"), (105, "text"), (None, "again")])


def test_search_equals_brute_force(spark, monkeypatch):
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, doc_id int")
    index = search.build_index(docs(spark, SEARCH_ROWS).repartition(3)).persist()
    want = brute_search(SEARCH_ROWS, ITEMS)
    for top, places in ((20, 4096), (3, 16)):  # so few places that almost all bounds are too high
        monkeypatch.setattr(search, "COORDINATES", places)
        if places == 16:
            monkeypatch.setattr(search, "BLOCK_ITEMS", 7)
            index = spark.createDataFrame(index_rows(SEARCH_ROWS), index.schema)
        got = Counter(map(tuple, search.search(index, items, top).select("item_id", "rank", "doc_id", "score").collect()))
        assert got == (want if top == 20 else brute_search(SEARCH_ROWS, ITEMS, top))


def index_rows(rows):
    """The index with the present number of places, made on the driver."""
    out = []
    for d, t in rows:
        c = search.term_counts((t or "").encode())
        if c:
            peaks = defaultdict(int)
            for x, k in c.items():
                peaks[search.coordinate(x)] = max(peaks[search.coordinate(x)], k)
            places = sorted(peaks)
            out.append((d, sum(c.values()), np.array(places, np.uint16).tobytes(), np.array([peaks[p] for p in places], np.int64).tobytes(),
                        b" ".join(c), np.array(list(c.values()), np.int64).tobytes()))
    return [tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in out]


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "abc")], "item_id long, text string")
    none = docs(spark, SEARCH_ROWS).limit(0)
    assert search.search(search.build_index(none), items).count() == 0
    assert search.search(search.build_index(docs(spark, SEARCH_ROWS)), items.limit(0)).count() == 0
    assert search.search(search.build_index(docs(spark, [(1, None), (2, " ")])), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_are_never_below_the_scores_and_long_texts_count_in_pieces(monkeypatch):
    texts = [prose(random.randint(1, 300)).encode() for _ in range(60)]
    whole = [search.term_counts(t) for t in texts]
    monkeypatch.setattr(search, "PIECE", 64)
    assert [search.term_counts(t) for t in texts] == whole and search.term_counts(b"a" * 1000 + b" b") == {b"a" * 1000: 1, b"b": 1}
    asked = [search.term_counts(prose(10).encode()) for _ in range(8)]
    df = Counter(t for c in whole for t in c)
    monkeypatch.setattr(search, "COORDINATES", 64)
    q = search.Queries(asked, {t: df[t] for a in asked for t in a if t in df}, len(texts), sum(sum(c.values()) for c in whole))
    equal = 0
    for c in whole:
        n, peaks = sum(c.values()), defaultdict(int)
        for t, k in c.items():
            peaks[search.coordinate(t)] = max(peaks[search.coordinate(t)], k)
        at = np.array(sorted(peaks))
        bound = q.bounds(np.array([n]), np.array([len(at)]), at, np.array([peaks[i] for i in at]))[0]
        exact = q.scores(list(c), np.array(list(c.values())), n)
        assert (bound >= exact).all()
        equal += int((bound == exact).sum())
    assert equal < 480


# ------------------------------------------------------------------ 12

CONVERSATION = "conv_id long, turn long, role string, text string, pos int, depth long, len int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], CONVERSATION)


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute_trie(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    out = {}
    for node, inside in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ends = ",".join(str(c) for c in sorted(inside) if len(paths[c]) == len(node))
        out[min(inside), len(node)] = (
            min(members[node[:-1]]) if node else None, len(inside), children[node], sum(not children[n] for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_rows(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def answer(nodes, ends):
    return nodes.join(trie.end_digests(ends), ["z1", "z2", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256)))


def some_conversations():
    said = [("user" if i % 2 else "assistant", w) for i, w in enumerate(["ä b", "c", "", "hello there", "é" * 30])]
    rows = [(c, t, *random.choice(said[:2] if t < 3 else said)) for c in range(70) for t in range(random.randint(1, 9))]
    rows += [(c, t, "user", f"again {t}") for c in range(1000, 1040) for t in range(5)]  # copies
    rows += [(2001, t, "user", f"long {t % 7}") for t in range(120)] + [(2002, t, "user", f"long {t % 7}" if t < 100 else "x") for t in range(110)]
    rows += [(3000, None, None, None), (3000, 0, "user", None), (3001, -5, "user", "first"), (3003, 1, "user", "no base"), (None, 1, "user", "lost")]
    rows += [(4000, 1, "user", "twice"), (4000, 1, "user", "twice")]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [8, 3])
def test_trie_equals_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)  # lists of ids in many pieces
    rows = some_conversations()
    nodes, ends = trie.prefix_trie(*trie.rebuilt(trie.turn_rows(conversations(spark, rows))), width)
    want = brute_trie(brute_rebuilt(rows))
    got = trie_rows(answer(nodes, ends))
    assert got == want and nodes.count() == len(want)


def test_trie_of_plain_conversations_gives_texts(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "user", "hi"), (2, 1, "bot", "no"), (3, 0, "bot", "hi")]
    df = conversations(spark, rows)
    turns = trie.turn_rows(df)
    nodes, _ = trie.prefix_trie(turns, turns.groupBy("conv").agg(F.max("pos").alias("len")))
    got = {(r.conv_id, r.depth): (r.role, r.text, r.n_convs, r.n_leaves, r.saved_tokens) for r in trie.node_texts(nodes, df).collect()}
    assert got == {(1, 0): (None, None, 3, 3, 2), (1, 1): ("user", "hi", 2, 2, 2), (1, 2): ("bot", "yes", 1, 1, 0),
                   (2, 2): ("bot", "no", 1, 1, 0), (3, 1): ("bot", "hi", 1, 1, 0)}


def test_trie_without_turns_or_conversations(spark):
    none = conversations(spark, some_conversations()).limit(0)
    nodes, ends = trie.prefix_trie(*trie.rebuilt(trie.turn_rows(none)))
    assert nodes.count() == 0 and trie.end_digests(ends).count() == 0
    c = next(c for c in range(1, 200, 5) if zlib.crc32(str(c).encode()) % 9 >= 1)  # loses its one turn, has no base
    got = trie_rows(answer(*trie.prefix_trie(*trie.rebuilt(trie.turn_rows(conversations(spark, [(c, 1, "user", "x")]))))))
    assert got == {(c, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


# ------------------------------------------------------------------ 13

def brute_spans(text):
    rules = [("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
              lambda m: len(m.group(2)) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m.group()) >= 24)]
    found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, rule, keep) in enumerate(rules) for m in re.finditer(rule, text) if keep(m)]
    return [x for _, _, x in sorted(found)]


HEX = hashlib.sha256(b"x").hexdigest()
SECRET_ROWS = [(1, f'é token = "{HEX}" and token=abc token = '), (2, f"AKIA{'Q' * 16} xAKIAAKIA{'7' * 15}"), (3, None), (4, ""), (5, "PassWord:secret:token:abcdef"),
               (6, "secret:token:abcdefgh paſſword=abcdefgh toKen=abcdefgh"), (7, f"{HEX[:23]} {HEX[:24]} {HEX.upper()}"), (8, "中" * 50 + f" api_key='{'Zz9/' * 400}' apikey : x.y-z_="),
               (9, f"AKIA{HEX[:30]}AKIA{'A' * 30}"), (10, "word " * 40_000 + f"passwd={HEX}"), (None, f"token={HEX}"), (2, f"AKIA{'Q' * 16} xAKIAAKIA{'7' * 15}"), (11, "=" * 5000 + "a1B2" * 30_000), (12, HEX), (13, HEX + HEX)]


@pytest.fixture(scope="module")
def network(spark):
    return credentials.train(docs(spark, [(100 + i, prose(50) + (f" token = {hashlib.md5(bytes([i])).hexdigest()}" if i % 3 == 0 else "")) for i in range(90)]))


def test_base_spans_equal_the_rules(spark, network):
    found = credentials.find_secrets(docs(spark, SECRET_ROWS), network).collect()
    got = Counter((r.doc_id, ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in r.findings if f["kind"] != "learned")) for r in found)
    assert got == Counter((d, ",".join(brute_spans(t or ""))) for d, t in SECRET_ROWS)
    for r in found:  # added spans overlap no base span
        base = [(f["start"], f["end"]) for f in r.findings if f["kind"] != "learned"]
        assert all(f["end"] <= a or f["start"] >= b for f in r.findings if f["kind"] == "learned" for a, b in base)
        assert [f["start"] for f in r.findings] == sorted(f["start"] for f in r.findings)
    assert credentials.find_secrets(docs(spark, SECRET_ROWS).limit(0), network).count() == 0


def test_network_finds_formats_the_rules_do_not_name(spark, network):
    examples = credentials.generated(320, [], seed=77)  # not the examples that it has learnt from
    cut = [credentials.window(np.frombuffer(a + c + b, np.uint8), len(a), len(a) + min(len(c), credentials.SPAN)) for a, c, b, _ in examples]
    p = network.probability(np.stack([w for w, _ in cut]), np.array([n for _, n in cut], dtype=np.float32))
    y = np.array([e[3] for e in examples])
    assert (p[y == 1] >= network.threshold).mean() > 0.85 and (p[y == 0] >= network.threshold).mean() < 0.1
    key = "ghp_" + "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=36))
    rows = [(1, f"é see {key} here"), (2, prose(300)), (3, "x" * 40 + " " + "internationalisation_of_names")]
    found = {r.doc_id: [(f["kind"], f["start"], f["end"]) for f in r.findings] for r in credentials.find_secrets(docs(spark, rows), network).collect()}
    assert found == {1: [("learned", 6, 46)], 2: [], 3: []}


def test_gradients_of_the_network(spark):
    net = credentials.Network(seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    codes, size, y = r.integers(0, credentials.CODES, (4, credentials.WIDTH)).astype(np.uint8), np.array([16.0, 30, 64, 20]), np.array([1.0, 0, 1, 0])
    loss = lambda: float(np.mean(np.logaddexp(0, (z := net._forward(codes, size)["logit"].astype(np.float64))) - y * z))
    g = net._gradients(net._forward(codes, size), y)
    for k in ("e", "w1", "b1", "w2", "w3"):
        flat, i = net.p[k].reshape(-1), int(np.argmax(np.abs(g[k])))
        was, h = flat[i], 1e-2
        flat[i] = was + h
        up = loss()
        flat[i] = was - h
        slope = (up - loss()) / (2 * h)
        flat[i] = was
        assert slope == pytest.approx(float(g[k].reshape(-1)[i]), rel=0.1, abs=1e-3), k


def test_redaction_replaces_the_spans(spark, network):
    rows = [(1, f"é token={HEX} end"), (2, "nothing"), (3, f"AKIA{'Q' * 16}"), (4, None)]
    d = docs(spark, rows).select("doc_id", "text")
    out = credentials.find_secrets(d, network).join(d, "doc_id").withColumn("clean", credentials.redacted(F.coalesce("text", F.lit("")), F.col("findings")))
    assert {r.doc_id: r.clean for r in out.collect()} == {1: "é [assign] end", 2: "nothing", 3: "[access]", 4: ""}


# ------------------------------------------------------------------ shared pieces

def test_first_rows_by_hash_are_the_same_with_and_without_a_threshold(spark):
    from vigil.llm.common import first_by_hash
    df = spark.range(20_000).withColumn("v", F.col("id") % 3)
    want = [r.id for r in df.orderBy(F.xxhash64("id")).limit(500).collect()]
    for total in (None, 20_000, 1):  # with 1 the threshold is left out
        assert [r.id for r in first_by_hash(df, "id", 500, total).collect()] == want
    assert first_by_hash(df.limit(3), "id", 500).count() == 3 and first_by_hash(df.limit(0), "id", 5).count() == 0


def test_learning_takes_every_candidate_in_shares(spark, monkeypatch):
    rows = [(i, f"see /var/lib/{hashlib.md5(b'%d' % i).hexdigest()}/x{i}" if i % 2 else f"by ordinary_name_of_a_thing_{i} and") for i in range(4000)]
    found = credentials.candidates(docs(spark, rows + rows[:50]))
    assert Counter(r.label for r in found.collect()) == Counter({0: 2000, 1: 2000})  # more than the bound of each label before
    monkeypatch.setattr(credentials, "SHARE", 2000)
    net = credentials.train(docs(spark, rows))
    assert net.step > 0
    examples = credentials.generated(160, [], seed=78)
    cut = [credentials.window(np.frombuffer(a + c + b, np.uint8), len(a), len(a) + min(len(c), credentials.SPAN)) for a, c, b, _ in examples]
    p = net.probability(np.stack([c for c, _ in cut]), np.array([n for _, n in cut], dtype=np.float32)) >= net.threshold
    y = np.array([e[3] for e in examples]) == 1
    assert p[y].mean() > 0.8 and p[~y].mean() < 0.2
