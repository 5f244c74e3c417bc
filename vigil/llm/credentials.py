"""Secret scan: fixed rules, and a character convolutional network over every candidate.

A candidate is a run of at least ``LEAST`` characters ``[A-Za-z0-9+/_.=-]``.  The network (numpy)
reads it in windows, so that all of a long run is seen, with ``BEFORE`` bytes before and
``AFTER`` bytes after: embedded bytes, one convolution, maxima and means inside the candidate and
maxima before it, two dense layers.  It learns from labelled findings: every distinct candidate of
the corpus, labelled by the fixed rules, and seeded examples of published key formats
and of look-alikes, set between surroundings of the corpus.  Tasks train on their shares, and the
networks are averaged after each epoch.  Temperature and offset are
calibrated on a part kept apart; the threshold is the largest that keeps ``RECALL`` of its
labelled secrets.  Spans of the fixed rules always stay, the network adds those it finds besides.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import first_by_hash, prepare, scratch, table, text_or_empty, utf8, written

#: bytes of a candidate at least; of a window of it, of the step to the next window, around it
LEAST, SPAN, STEP, BEFORE, AFTER = 16, 64, 48, 32, 16
WIDTH = BEFORE + SPAN + AFTER
#: what all corpus candidates of a label weigh at most, generated examples of each label (weight 1 each)
CORPUS_WEIGHT, GENERATED = 1_500, 1_500
#: examples that a task trains on in an epoch; width of a bin of the logits for the calibration
SHARE, BIN = 32_768, 1 / 64
RECALL = 0.95
EPOCHS, BATCH, SEED = 10, 128, 11

# The rules, in order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 6
KEYWORDS = "(?i)password|passwd|secret|token|api_?key"
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
LEARNED = "learned"

_IN_RUN = np.zeros(256, dtype=bool)
_IN_RUN[[ord(c) for c in string.ascii_letters + string.digits + "+/_.=-"]] = True
#: 0 stands for nothing (before or after the text), then printable ASCII, line end, other control, other bytes
_CODE = np.array([96 if b == 10 else 97 if b < 32 or b == 127 else 98 if b > 127 else b - 31 for b in range(256)], dtype=np.uint8)
CODES = 99


@dataclass
class Text:
    """The bytes of one document and its candidates (byte starts and ends)."""
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keyed: bool


def texts(column: pa.Array) -> Iterator[Text]:
    """The documents of an Arrow column of strings, with their candidates."""
    data, off = utf8(column)
    keyed = pc.fill_null(pc.match_substring_regex(column, KEYWORDS), False).to_pylist()
    body = np.zeros(len(data) + 2, dtype=bool)
    body[1:-1] = _IN_RUN[data]
    first, last = body[1:-1] & ~body[:-2], body[1:-1] & ~body[2:]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[inner] |= body[1:-1][inner]  # a run ends with its document
    last[inner - 1] |= body[1:-1][inner - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    a, b = a[b - a >= LEAST], b[b - a >= LEAST]
    cut = np.searchsorted(a, off)
    for i in range(len(off) - 1):
        own = slice(cut[i], cut[i + 1])
        yield Text(data[off[i]:off[i + 1]], a[own] - off[i], b[own] - off[i], bool(keyed[i]))


def rule_spans(text: Text) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) in bytes.  Each long run of hex digits or upper-case key
    characters lies in a candidate, so only the first rule reads the text."""
    out = []
    if text.keyed:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text.raw.tobytes()) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    for a, b in zip(text.starts, text.ends):
        run = text.raw[a:b].tobytes()
        for kind, rule in ((1, ACCESS), (2, HEX)):
            out += [(int(a) + m.start(), int(a) + m.end(), kind) for m in rule.finditer(run)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def window(raw: np.ndarray, start: int, end: int) -> tuple[np.ndarray, int]:
    """Codes around ``raw[start:end]`` (at most SPAN bytes), and its length."""
    codes = np.zeros(WIDTH, dtype=np.uint8)
    lo, hi = max(0, start - BEFORE), min(len(raw), end + AFTER)
    at = BEFORE - (start - lo)
    codes[at:at + hi - lo] = _CODE[raw[lo:hi]]
    return codes, end - start


def windows(raw: np.ndarray, start: int, end: int) -> list[tuple[np.ndarray, int]]:
    """Windows that cover the candidate."""
    at = range(start, max(start + 1, end - SPAN + STEP), STEP)
    return [window(raw, a, min(a + SPAN, end)) for a in at]


class Network:
    """embedding, convolution, pooling, dense layer, output; trained with Adam."""
    E, K, FILTERS, HIDDEN = 8, 5, 24, 24

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        shapes = {"e": (CODES, self.E), "w1": (self.K * (self.E + 1), self.FILTERS), "b1": (self.FILTERS,),
                  "w2": (3 * self.FILTERS + 1, self.HIDDEN), "b2": (self.HIDDEN,), "w3": (self.HIDDEN,), "b3": (1,)}
        self.p = {k: (r.normal(0, (2 / s[0]) ** 0.5 if k != "e" else 0.5, s) if k[0] != "b" else np.zeros(s)).astype(np.float32)
                  for k, s in shapes.items()}
        self.m, self.v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        self.step = 0
        self.temperature, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray, size: np.ndarray) -> dict:
        p, place = self.p, np.arange(WIDTH)
        inside = (place >= BEFORE) & (place < BEFORE + size[:, None])
        x = np.concatenate([p["e"][codes], inside[:, :, None]], axis=2, dtype=np.float32)
        cols = np.lib.stride_tricks.sliding_window_view(x, self.K, axis=1).transpose(0, 1, 3, 2)
        cols = cols.reshape(len(codes), WIDTH - self.K + 1, -1)
        a = np.maximum(cols @ p["w1"] + p["b1"], 0)
        half = self.K // 2
        own = inside[:, half:-half, None]
        left = (place < BEFORE)[None, half:-half, None]
        mean = (a * own).sum(1) / size[:, None]
        top, before = (a * own).argmax(1), (a * left).argmax(1)
        pick = lambda at: np.take_along_axis(a, at[:, None, :], 1)[:, 0]
        f = np.concatenate([pick(top), mean, pick(before), np.log(size)[:, None] / 4], axis=1, dtype=np.float32)
        h = np.maximum(f @ p["w2"] + p["b2"], 0)
        return {"cols": cols, "a": a, "own": own, "top": top, "before": before, "f": f, "h": h,
                "logit": h @ p["w3"] + p["b3"][0], "codes": codes, "size": size}

    def _gradients(self, s: dict, y: np.ndarray, weight: np.ndarray | float = 1.0) -> dict:
        p, n, m = self.p, len(y), self.FILTERS
        d = ((1 / (1 + np.exp(-s["logit"])) - y) * weight / n).astype(np.float32)
        g = {"w3": s["h"].T @ d, "b3": d.sum(keepdims=True)}
        dh = d[:, None] * p["w3"] * (s["h"] > 0)
        g["w2"], g["b2"] = s["f"].T @ dh, dh.sum(0)
        df = dh @ p["w2"].T
        da = df[:, None, m:2 * m] / s["size"][:, None, None] * s["own"]
        rows, cols = np.arange(n)[:, None], np.arange(m)[None]
        np.add.at(da, (rows, s["top"], cols), df[:, :m])
        np.add.at(da, (rows, s["before"], cols), df[:, 2 * m:3 * m])
        da = (da * (s["a"] > 0)).astype(np.float32)
        flat = da.reshape(-1, m)
        g["w1"], g["b1"] = s["cols"].reshape(len(flat), -1).T @ flat, flat.sum(0)
        dx = (da @ p["w1"].T).reshape(n, WIDTH - self.K + 1, self.K, self.E + 1)[..., :self.E]
        g["e"] = np.zeros_like(p["e"])
        for k in range(self.K):
            np.add.at(g["e"], s["codes"][:, k:k + dx.shape[1]], dx[:, :, k])
        return g

    def logits(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = [self._forward(codes[i:i + 512], size[i:i + 512])["logit"] for i in range(0, len(size), 512)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def probability(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logits(codes, size).astype(np.float64) / self.temperature + self.offset)))

    def learn(self, codes: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step of Adam; weights are 1 on average."""
        self.step += 1
        g = self._gradients(self._forward(codes, size), y, weight)
        for k, a in self.p.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.999 * self.v[k] + 0.001 * g[k] ** 2
            a -= (3e-3 * (self.m[k] / (1 - 0.9 ** self.step)) / (np.sqrt(self.v[k] / (1 - 0.999 ** self.step)) + 1e-8)).astype(np.float32)

    def state(self) -> np.ndarray:
        return np.concatenate([a.ravel().astype(np.float64) for part in (self.p, self.m, self.v) for a in part.values()])

    def restore(self, state: np.ndarray, step: int) -> None:
        at, self.step = 0, step
        for part in (self.p, self.m, self.v):
            for k, a in part.items():
                part[k] = state[at:at + a.size].reshape(a.shape).astype(np.float32)
                at += a.size

    def calibrated(self, logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> "Network":
        self._calibrate(logit, y, weight)
        order = np.argsort(logit[y == 1], kind="stable")
        if len(order):
            good, held = logit[y == 1][order], np.cumsum(weight[y == 1][order])
            least = good[min(np.searchsorted(held, (1 - RECALL) * held[-1], side="right"), len(good) - 1)]
            self.threshold = float(1 / (1 + np.exp(-(least / self.temperature + self.offset))))
        return self

    def _calibrate(self, logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Newton steps for probability = sigmoid(logit / temperature + offset), lightly held."""
        if not len(y):
            return
        x, w = np.stack([logit, np.ones_like(logit)], axis=1), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            back = 0.1 * (w - [1.0, 0.0])
            change = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.1 * np.eye(2), x.T @ (weight * (p - y)) + back)
            w = w - change
            w[0] = max(w[0], 0.05)
            if np.abs(change).max() < 1e-9:
                break
        self.temperature, self.offset = 1 / w[0], w[1]


def generated(number: int, surroundings: list[tuple[bytes, bytes]], seed: int = SEED) -> list[tuple[bytes, bytes, bytes, int]]:
    """(before, candidate, after, label): ``number`` secrets in published key formats and as many
    look-alikes, each between given surroundings or those of a setting."""
    r = random.Random(seed)
    of = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    letters, alnum, low = string.ascii_letters, string.ascii_letters + string.digits, string.ascii_lowercase
    base64, url, hexa, upper = alnum + "+/", alnum + "_-", "0123456789abcdef", string.ascii_uppercase + string.digits
    word = lambda a=2, b=9: of(low, r.randint(a, b))
    secrets = [lambda: "ghp_" + of(alnum, 36), lambda: "glpat-" + of(url, 20), lambda: "npm_" + of(alnum, 36),
               lambda: f"xoxb-{of(string.digits, 12)}-{of(string.digits, 12)}-{of(alnum, 24)}", lambda: "sk_live_" + of(alnum, 24),
               lambda: "AIza" + of(url, 35), lambda: f"SG.{of(url, 22)}.{of(url, 43)}", lambda: "AKIA" + of(upper, 16),
               lambda: f"eyJ{of(url, 33)}.eyJ{of(url, 60)}.{of(url, 43)}", lambda: of(base64, 40), lambda: of(base64, 43) + "=",
               lambda: of(hexa, r.choice((32, 40, 64))), lambda: of(alnum, r.randint(20, 48)), lambda: of(upper, r.randint(20, 32)),
               lambda: word(6, 8) + "=" + of(hexa, r.randint(16, 40)), lambda: of(hexa, r.randint(16, 24))]
    others = [lambda: "".join(word(4, 7) for _ in range(r.randint(3, 6))), lambda: of(low, r.randint(16, 24)).capitalize(),
              lambda: "/" + "/".join(word() for _ in range(r.randint(4, 8))), lambda: ".".join(word(4, 9) for _ in range(r.randint(3, 5))),
              lambda: "_".join(word(3, 8) for _ in range(r.randint(3, 6))), lambda: "-".join(word(3, 8) for _ in range(r.randint(3, 6))),
              lambda: of(string.digits, r.randint(16, 20)), lambda: r.choice("=-_.") * r.randint(16, 60),
              lambda: f"20{of('012', 1)}{of(string.digits, 1)}-0{of('123456789', 1)}-1{of(string.digits, 1)}.{of('01', 1)}{of(string.digits, 1)}.{of('12345', 1)}0",
              lambda: f"{word(5, 9)}.{of(string.digits, 2)}.{word(4, 8)}.{r.choice(('com', 'org', 'net'))}", lambda: "www." + word(8, 14) + ".com/" + word(),
              lambda: "".join(word(4, 8).capitalize() for _ in range(r.randint(3, 5))), lambda: of(upper[:26], r.randint(16, 24)),
              lambda: f"{of(hexa, 8)}-{of(hexa, 4)}-4{of(hexa, 3)}-{of(hexa, 4)}-{of(hexa, 12)}",
              lambda: f"{word(4, 8)}-{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}-{word(3, 6)}.{r.choice(('tar.gz', 'whl', 'jar'))}",
              lambda: "+".join(word(3, 7) for _ in range(r.randint(4, 6)))]
    settings = [lambda: (f"{word()} = \"", "\"\n"), lambda: (f"export {word(3, 7).upper()}=", "\n"), lambda: (f"{word()}: ", "\n"),
                lambda: (f"{{\"{word()}\": \"", "\", \""), lambda: (f"{word()} {word()} ", f" {word()} {word()}"), lambda: (f"see {word()} ", ". "),
                lambda: ("Authorization: Bearer ", "\n"), lambda: (f"https://{word()}.org/?q=", " ")]
    out = []
    for label, makers in ((1, secrets), (0, others)):
        for i in range(number):
            before, after = r.choice(surroundings) if surroundings and r.random() < 0.5 else tuple(s.encode() for s in r.choice(settings)())
            out.append((before, makers[i % len(makers)]().encode(), after, label))
    return out


EXAMPLE = "label int, near binary, at int, size int"


def candidates(docs: DataFrame) -> DataFrame:
    """The distinct candidates of all texts: label by the fixed rules, bytes around, place and size in them."""
    def run(batches):
        for batch in batches:
            rows = []
            for text in texts(batch.column(0)):
                spans = rule_spans(text)
                for a, b in zip(text.starts, text.ends):
                    near = text.raw[max(0, a - BEFORE):min(b, a + SPAN) + AFTER].tobytes()
                    rows.append((int(any(s < b and e > a for s, e, _ in spans)), near, int(min(BEFORE, a)), int(min(b - a, SPAN))))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.int32(), pa.int32()))],
                                             names=["label", "near", "at", "size"])
    return docs.select(text_or_empty().alias("text")).mapInArrow(run, EXAMPLE).distinct()


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, sizes, labels and weights of a batch of examples."""
    label, near, at, size, weight = (c.to_pylist() for c in batch.columns)
    codes = np.zeros((len(label), WIDTH), dtype=np.uint8)
    for i, (raw, a, n) in enumerate(zip(near, at, size)):
        codes[i] = window(np.frombuffer(raw, np.uint8), a, a + n)[0]
    return codes, np.array(size, dtype=np.float32), np.array(label, dtype=np.float32), np.array(weight, dtype=np.float32)


def train(docs: DataFrame, corpus_weight: int = CORPUS_WEIGHT, number: int = GENERATED) -> Network:
    """The network learnt from every distinct candidate of ``docs`` and ``number`` generated ones of
    each label.  The candidates of a label weigh ``corpus_weight`` together, or 1 each where they are fewer."""
    spark = docs.sparkSession
    prepare(spark)
    with scratch(spark):
        found = written(candidates(docs), "candidates")
        held_by = {r.label: r["count"] for r in found.groupBy("label").count().collect()}
        # generated examples stand in some of the surroundings that the corpus has
        plain = first_by_hash(found.filter("label = 0"), "near", number, held_by.get(0, 0)).collect()
        plain = sorted((bytes(r.near[:r.at]), bytes(r.near[r.at + r.size:])) for r in plain)
        made = [(label, a + c[:SPAN] + b, len(a), min(len(c), SPAN), 1.0) for a, c, b, label in generated(number, plain)]
        each = F.when(F.col("label") == 1, F.lit(min(1.0, corpus_weight / max(1, held_by.get(1, 0))))).otherwise(
            F.lit(min(1.0, corpus_weight / max(1, held_by.get(0, 0)))))
        rows = found.withColumn("weight", each).unionByName(spark.createDataFrame(made, EXAMPLE + ", weight double"))
        rows = written(rows.withColumn("held", F.crc32(F.concat(F.lit("calibrate").cast("binary"), "near")) % 4 == 0), "examples")
        total, mean = rows.filter("not held").agg(F.count("*"), F.avg("weight")).first()
        model, shares = Network(), -(-total // SHARE)
        for epoch in range(EPOCHS):
            state, step = model.state(), model.step

            def learn(batches):
                own = Network()
                own.restore(state, step)
                for batch in batches:
                    for lo in range(0, batch.num_rows, BATCH):
                        codes, size, y, weight = _arrays(batch.slice(lo, BATCH))
                        own.learn(codes, size, y, weight / mean)
                if own.step > step:
                    yield pa.RecordBatch.from_arrays([pa.array([own.step - step], pa.int64()), pa.array([own.state().tobytes()], pa.binary())],
                                                     names=["steps", "state"])
            order = [F.xxhash64(F.lit(SEED), F.lit(epoch), "near", "at", "size"), "near", "at", "size", "label"]
            dealt = rows.filter("not held").withColumn("_share", F.pmod(F.xxhash64("near", "at", "size"), F.lit(shares)))
            dealt = dealt.repartition(shares, "_share").sortWithinPartitions(*order).select("label", "near", "at", "size", "weight")
            parts = sorted((r.steps, bytes(r.state)) for r in dealt.mapInArrow(learn, "steps long, state binary").collect())  # one small row a share
            steps = np.array([n for n, _ in parts], dtype=np.float64)
            model.restore(sum(np.frombuffer(s) * n for n, s in parts) / steps.sum(), step + int(steps.max()))
        trained = model

        def score(batches):
            for batch in batches:
                codes, size, y, weight = _arrays(batch)
                bins = np.rint(trained.logits(codes, size).astype(np.float64) / BIN).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(y.astype(np.int32)), pa.array(weight.astype(np.float64))],
                                                 names=["bin", "label", "weight"])
        apart = rows.filter("held").select("label", "near", "at", "size", "weight").mapInArrow(score, "bin long, label int, weight double")
        # logits of the part kept apart, by bins: the number of rows follows from their range
        bins = sorted(tuple(r) for r in apart.groupBy("bin", "label").agg(F.count("*").alias("n"), F.max("weight").alias("w")).collect())
        table_ = np.array(bins, dtype=np.float64).reshape(-1, 4)
        return model.calibrated(table_[:, 0] * BIN, table_[:, 1], table_[:, 2] * table_[:, 3])


def _findings(text: Text, model: Network) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, score) in code points, by start and kind."""
    spans = [(a, b, k, None) for a, b, k in rule_spans(text)]
    if len(text.starts):
        cut = [windows(text.raw, int(a), int(b)) for a, b in zip(text.starts, text.ends)]
        flat = [w for own in cut for w in own]
        first = np.cumsum([0, *map(len, cut)])[:-1]
        score = np.concatenate([model.probability(np.stack([c for c, _ in part]), np.array([n for _, n in part], dtype=np.float32))
                                for part in (flat[i:i + 4096] for i in range(0, len(flat), 4096))])
        for a, b, s in zip(text.starts, text.ends, np.maximum.reduceat(score, first)):
            if s >= model.threshold and not any(x < b and y > a for x, y, _, _ in spans if _ is None):
                spans.append((int(a), int(b), len(KINDS), float(s)))
    if not spans:
        return []
    spans.sort(key=lambda s: (s[0], s[2]))
    points = np.concatenate(([0], np.cumsum((text.raw & 0xC0) != 0x80)))
    return [((*KINDS, LEARNED)[k], int(points[a]), int(points[b]), s) for a, b, k, s in spans]


def find_secrets(docs: DataFrame, model: Network) -> DataFrame:
    """(doc_id, findings: array of kind, start, end, score) of every row; positions are code
    points, end exclusive, findings by start and kind; score is null for the fixed rules.

    Null and empty texts have no findings; repeated rows are scanned alike; other columns are
    ignored; an empty table gives no rows.  All of a very long text is scanned.
    """
    prepare(docs.sparkSession)
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [[dict(zip(("kind", "start", "end", "score"), f)) for f in _findings(t, model)] for t in texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(one))], names=["doc_id", "findings"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, findings array<struct<kind: string, start: long, end: long, score: double>>")


def redacted(text, findings):
    """``text`` with every found span replaced by the name of its kind in brackets."""
    pieces = F.aggregate(
        findings, F.struct(F.lit(1).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, f: F.when(f["end"] < s["at"], s).otherwise(F.struct(
            (f["end"] + 1).alias("at"), F.when(f["start"] + 1 < s["at"], s["out"]).otherwise(
                F.concat(s["out"], F.substring(text, s["at"].cast("int"), (f["start"] + 1 - s["at"]).cast("int")),
                         F.lit("["), f["kind"], F.lit("]"))).alias("out"))))
    return F.concat(pieces["out"], F.substring(text, pieces["at"].cast("int"), F.length(text)))


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    """Spans of secrets of every document.  Nulls, repeats, long texts: see ``find_secrets``."""
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, train(docs))
    joined = lambda column: F.array_join(F.transform(column, lambda f: F.concat_ws(
        ":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["kind"] != LEARNED)
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("findings")).alias("spans"), count(LEARNED).alias("n_learned"))
