"""Secret scanning: base patterns, and a character convolutional network over every candidate.

A candidate is a run of 8 or more printable characters that has a digit or a capital after a small letter, any run of 20 or more, or a
run of 6 or more behind a word such as password, key or login; quotes and stops around it are left out. The network reads it with the characters around it, in
windows of fixed size that cover it wholly, and is plain numpy. It is trained on labelled findings: values of many kinds of secrets
and of what looks alike (``findings``), and all of the corpus's own candidates: those in a base match are secrets, the others are none, but for
those that a first network, trained on the made findings alone, takes for secrets more likely than not: nobody has labelled these, so they are left out.
The first network then goes through the whole corpus in ``ROUNDS`` rounds. In each the tasks start from the same weights, pass once over
their windows and the made ones, and the mean of their weights, by number of windows, is where the next round starts.
A quarter of the findings is held out with all its windows, and of the corpus what stands in a quarter of the texts: on all of it the scores are
calibrated (Platt scaling) as they are used, the highest of a span's windows, and the threshold is the highest one that still
finds ``RECALL`` of the held-out secrets of every kind, the corpus's own being one; of the corpus each step of the scores is counted. Half of the secrets and
a quarter of the others lose what stands before them in training, so that the network also learns what values look like. The base spans never depend on the network.

Nulls, ties and odd rows: a null text is empty and has no spans. Rows are judged one by one, so repeated and null ids need no
care, and ties cannot arise. A text of any length is searched whole. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value, stored
from .findings import findings

#: Findings of each kind that are made.
MADE = 480
RECALL = 0.97
#: Times that a window of the corpus is read in a round of training, at most.
OFTEN = 16
#: Rounds over the corpus, the rate they start from, and windows of the corpus that a task has in each, about.
ROUNDS, ROUND_RATE, TASK_WINDOWS = 6, 0.003, 16_384
#: Whole numbers stand for weights in sums, so these are exact in any order, and for logits where they are counted: steps in a unit.
WEIGHT_STEPS, LOGIT_STEPS = 1 << 24, 1 << 10
#: Characters of a window: context, part of the candidate, context.
CONTEXT, PART = 20, 40
WIDTH = PART + 2 * CONTEXT
KINDS = ("assign", "access", "hex", "network")

_KEYWORDS = ("password", "passwd", "secret", "token", "api")
_TOLD = (*_KEYWORDS, "passphrase", "pwd", "pw", "credential", "bearer", "key", "login", "auth")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
#: Printable characters but quotes, which bound a value.
_RUN = "[!#-&(-_a-~]"
CANDIDATE = re.compile(f"(?<!{_RUN})(?:(?={_RUN}*(?:[0-9]|[a-z][A-Z])){_RUN}{{8,}}|{_RUN}{{20,}})")
KEYED = re.compile(r"(?i:passw(?:or)?d|passphrase|pwd|\bpw|secret|token|key|credential|bearer|\blogin|\bauth)(?:\x20is|\x20was|\x20with)?[\x20:=\"']{1,4}([!#-&(-_a-~]{6,})")
EDGES = ".,;:()[]{}<>|"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, by start and then kind."""
    out = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of all that the network judges, in order."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    if any(k in text.lower() for k in _TOLD):
        found += [m.span(1) for m in KEYED.finditer(text)]
    out = set()
    for a, z in found:
        value = text[a:z]
        a, z = a + len(value) - len(value.lstrip(EDGES)), z - len(value) + len(value.rstrip(EDGES))
        if z - a >= 6:
            out.add((a, z))
    return sorted(out)


def windows(text: str, start: int, end: int) -> list[str]:
    """Windows that cover text[start:end], each with the context around its part; outside the text there are null characters."""
    out = []
    for a in range(start, end, PART):
        z = min(a + PART, end)
        left, right = text[max(0, a - CONTEXT) : a], text[z : z + CONTEXT]
        out.append(left.rjust(CONTEXT, "\0") + text[a:z].ljust(PART, "\0") + right.ljust(CONTEXT, "\0"))
    return out


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and candidates of every text."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
    seen = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.int32()), ("source", pa.int64()), ("windows", pa.list_(pa.string()))]))
    for batch in batches:
        base, found = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "stop": z} for a, k, z in spans])
            own, source = [], zlib.crc32(text.encode())
            for a, z in candidates(text):
                inside = any(s < z and a < e for s, _, e in spans)
                own.append({"start": a, "stop": z, "label": int(inside), "source": source, "windows": windows(text, a, z)})
            found.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(found, seen)], names=["doc_id", "base", "candidates"])


def encode(texts: list[str]) -> np.ndarray:
    """Window characters as small integers: ASCII as it is, all others as 1."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).reshape(len(texts), WIDTH)
    return np.where(codes < 128, codes, 1).astype(np.int64)


class CharNetwork:
    """Embedding, one convolution with ReLU, maximum and mean over places, one output; trained by Adam on the logistic loss."""

    def __init__(self, filters: int = 32, size: int = 8, span: int = 5, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.span = span
        made = {
            "embed": rng.normal(0, 0.3, (128, size)),
            "place": rng.normal(0, 0.3, (2, size)),
            "conv": rng.normal(0, (2 / (span * size)) ** 0.5, (span * size, filters)),
            "bias": np.zeros(filters),
            "out": rng.normal(0, 0.3, 2 * filters),
            "shift": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in made.items()}
        self.inside = np.zeros(WIDTH, dtype=np.int64)
        self.inside[CONTEXT : CONTEXT + PART] = 1
        self.scale, self.offset, self.threshold = 1.0, 0.0, 2.0

    def _forward(self, x: np.ndarray):
        p, places = self.p, WIDTH - self.span + 1
        e = p["embed"][x] + p["place"][self.inside]
        cols = np.concatenate([e[:, k : places + k] for k in range(self.span)], axis=2)
        act = np.maximum(cols @ p["conv"] + p["bias"], 0)
        best = act.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(act, best[:, None], axis=1)[:, 0], act.mean(axis=1)], axis=1)
        return cols, act, best, pooled, pooled @ p["out"] + p["shift"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[4] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def weights(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def with_weights(self, weights: np.ndarray) -> CharNetwork:
        """A network of this form with other weights, not calibrated."""
        other = CharNetwork(span=self.span)
        parts = np.split(weights.astype(np.float32), np.cumsum([v.size for v in self.p.values()])[:-1])
        other.p = {k: w.reshape(v.shape) for (k, v), w in zip(self.p.items(), parts, strict=True)}
        return other

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.005, seed: int = 11, along: tuple[float, float] = (0, 1)) -> None:
        """Adam whose rate falls to nothing along a half cosine, or along a part of it."""
        rng, step, filters = np.random.default_rng(seed), 0, self.p["bias"].size
        last = epochs * -(-len(x) // batch)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        size = self.p["embed"].shape[1]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick = order[i : i + batch]
                xb = x[pick].copy()
                xb[rng.random(len(pick)) < np.where(y[pick] == 1, 0.5, 0.25), :CONTEXT] = 0
                cols, act, best, pooled, z = self._forward(xb)
                n, places = act.shape[:2]
                dz = ((1 / (1 + np.exp(-z)) - y[pick]) / n).astype(np.float32)
                g = {"out": pooled.T @ dz, "shift": np.array([dz.sum()], dtype=np.float32)}
                # the maximum passes its share to one place, the mean to all
                da = np.broadcast_to((dz[:, None] * self.p["out"][filters:] / places)[:, None], act.shape).copy()
                np.put_along_axis(da, best[:, None], np.take_along_axis(da, best[:, None], axis=1) + (dz[:, None] * self.p["out"][:filters])[:, None], axis=1)
                da[act <= 0] = 0
                g["conv"] = np.tensordot(cols, da, axes=([0, 1], [0, 1]))
                g["bias"] = da.sum(axis=(0, 1))
                dcols = da @ self.p["conv"].T
                de = np.zeros((n, WIDTH, size), dtype=np.float32)
                for k in range(self.span):
                    de[:, k : places + k] += dcols[:, :, k * size : (k + 1) * size]
                flat = xb.reshape(-1)
                g["embed"] = np.stack([np.bincount(flat, weights=de[:, :, k].reshape(-1), minlength=128) for k in range(size)], axis=1)
                g["place"] = np.stack([de[:, self.inside == k].sum(axis=(0, 1)) for k in (0, 1)])
                now = rate * (1 + np.cos(np.pi * (along[0] + (along[1] - along[0]) * step / last))) / 2
                step += 1
                for name, grad in g.items():
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v[name] = 0.999 * v[name] + 0.001 * grad**2
                    self.p[name] = (self.p[name] - now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def calibrate(self, x: np.ndarray, y: np.ndarray, span: np.ndarray, kind: np.ndarray, recall: float) -> None:
        """``settle`` on windows of held-out spans."""
        self.settle(self.held(x, y, span, kind), recall)

    def held(self, x: np.ndarray, y: np.ndarray, span: np.ndarray, kind: np.ndarray) -> pd.DataFrame:
        """The highest logit of each span, its label and kind, and how many such there are."""
        _, first, of = np.unique(span, return_index=True, return_inverse=True)
        z = np.full(len(first), -np.inf)
        np.maximum.at(z, of, self.logits(x))
        return pd.DataFrame({"z": z, "label": y[first], "kind": kind[first], "n": 1})

    def settle(self, held: pd.DataFrame, recall: float) -> None:
        """Platt scaling of logits, and the highest threshold that has the wanted recall in each kind of secrets."""
        z, y, n = held["z"].to_numpy(dtype=float), held["label"].to_numpy(), held["n"].to_numpy()
        share, a, b = n / n.sum(), 1.0, 0.0
        for _ in range(400):
            off = (1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y) * share
            a, b = a - 0.05 * float((off * z).sum()), b - 0.05 * float(off.sum())
        self.scale, self.offset, self.threshold = max(a, 1e-3), b, 2.0
        for _, hits in held[held["label"] == 1].sort_values("z").groupby("kind"):
            upto = hits["n"].cumsum().to_numpy()
            least = hits["z"].to_numpy()[np.searchsorted(upto, int((1 - recall) * upto[-1]), side="right")]
            self.threshold = min(self.threshold, float(self._calibrated(least)))

    def _calibrated(self, logits):
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.offset, -30, 30)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._calibrated(self.logits(x))


def _arrays(findings: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Codes, labels, kinds and numbers of findings, and which of these are held out: with all its windows, so nothing of what is held out has been seen."""
    span = findings["finding"].to_numpy(dtype=np.int64)
    return encode(findings["window"].tolist()), findings["label"].to_numpy(dtype=np.int64), findings["kind"].to_numpy(dtype=str), span, span % 4 == 0


def train(findings: pd.DataFrame, recall: float = RECALL) -> CharNetwork:
    """Fit on made findings (window, label, kind, finding); a quarter is held out for calibration and the threshold."""
    network = CharNetwork()
    if findings["label"].nunique() < 2:
        return network
    x, y, kind, span, held = _arrays(findings)
    network.fit(x[~held], y[~held])
    if len(set(y[held])) == 2:
        network.calibrate(x[held], y[held], span[held], kind[held], recall)
    return network


def survey(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    schema = "doc_id long, base array<struct<start:long,kind:int,stop:long>>, candidates array<struct<start:long,stop:long,label:int,source:long,windows:array<string>>>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_survey, schema)


def corpus_windows(surveyed: DataFrame, first: CharNetwork) -> DataFrame:
    """All different windows of the corpus with their labels (window, label, held); unlabelled ones that ``first`` takes for secrets are left out.

    A window that several texts have is on the side of one of them, so nothing of what is held out is also trained on.
    """
    flat = surveyed.select(F.explode("candidates").alias("c")).select(F.explode("c.windows").alias("window"), F.col("c.label").alias("label"), F.col("c.source").alias("source"))
    sided = flat.groupBy("window").agg(F.collect_set("label").alias("labels"), (F.min("source") % 4 == 0).alias("held"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            secret = batch.column(1).to_numpy() == 1
            unlike = first.scores(encode(batch.column(0).to_pylist())) < 0.5 if batch.num_rows else secret
            yield batch.filter(pa.array(secret | unlike))

    return sided.select("window", F.explode("labels").alias("label"), "held").mapInArrow(judged, "window string, label int, held boolean")


def _round(network: CharNetwork, made: np.ndarray, made_labels: np.ndarray, turn: int):
    """A pass from the network's weights over the made windows and a part of the corpus's: each weight in steps, times the part's windows."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("window", "ascending"), ("label", "ascending")])
        x, y = encode(part["window"].to_pylist()), part["label"].to_numpy().astype(np.int64)
        # the corpus's own windows may be few; they are read as often as the made ones, at most OFTEN times each
        often = np.ones(len(x), dtype=np.int64)
        for label in (0, 1):
            if (y == label).any():
                often[y == label] = np.clip((made_labels == label).sum() // (y == label).sum(), 1, OFTEN)
        own = network.with_weights(network.weights())
        own.fit(np.r_[made, np.repeat(x, often, axis=0)], np.r_[made_labels, np.repeat(y, often)], epochs=1, rate=ROUND_RATE, seed=turn, along=(turn / ROUNDS, (turn + 1) / ROUNDS))
        steps = np.rint(own.weights().astype(np.float64) * WEIGHT_STEPS).astype(np.int64)
        return pa.table({"at": np.arange(len(steps)), "total": steps * len(x), "n": np.full(len(steps), len(x))})

    return run


def _counted(network: CharNetwork):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = network.logits(encode(batch.column(0).to_pylist())) if batch.num_rows else np.zeros(0)
            step = np.floor(np.clip(z, -64, 64) * LOGIT_STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(1)], names=["step", "label"])

    return run


def learn(surveyed: DataFrame, recall: float = RECALL) -> CharNetwork:
    """The network that has gone through the made findings and the whole corpus but for what is held out; that settles its threshold, also whole."""
    findings = made_findings()
    network = train(findings, recall)
    x, y, kind, span, held = _arrays(findings)
    own = stored(corpus_windows(surveyed, network), "labelled-windows")
    seen = own.where("not held")
    parts = -(-seen.count() // TASK_WINDOWS)
    for turn in range(ROUNDS if parts else 0):
        dealt = seen.select("window", "label", F.pmod(F.xxhash64("window"), F.lit(parts)).alias("part")).repartition(2 * parts, "part")
        passed = dealt.groupBy("part").applyInArrow(_round(network, x[~held].astype(np.uint8), y[~held], turn), "at long, total long, n long")
        sums = passed.groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas().sort_values("at")
        network = network.with_weights((sums["total"] / sums["n"]).to_numpy() / WEIGHT_STEPS)
    counted = own.where("held").mapInArrow(_counted(network), "step long, label int").groupBy("step", "label").agg(F.count("*").alias("n")).toPandas()
    corpus = pd.DataFrame({"z": counted["step"] / LOGIT_STEPS, "label": counted["label"], "kind": "corpus", "n": counted["n"]}).sort_values(["z", "label"])
    network.settle(pd.concat([network.held(x[held], y[held], span[held], kind[held]), corpus], ignore_index=True), recall)
    return network


def made_findings(per_kind: int = MADE, seed: int = 5, kinds: set[str] | None = None) -> pd.DataFrame:
    """Windows of findings made by rule, of all kinds or some: window, label, kind and the number of the finding."""
    rows = [(w, label, kind, at) for at, (kind, label, text, a, z) in enumerate(findings(per_kind, seed)) if kinds is None or kind in kinds for w in windows(text, a, z)]
    return pd.DataFrame(rows, columns=["window", "label", "kind", "finding"])


def _score(network: CharNetwork):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("candidates").to_pylist()
            texts, owner = [], []
            for i, row in enumerate(rows):
                for k, c in enumerate(row):
                    texts += c["windows"]
                    owner += [(i, k)] * len(c["windows"])
            best: dict[tuple[int, int], float] = {}
            for at in range(0, len(texts), 4096):
                for key, s in zip(owner[at : at + 4096], network.scores(encode(texts[at : at + 4096])).tolist(), strict=True):
                    best[key] = max(best.get(key, 0.0), s)
            out = []
            for i, (row, base) in enumerate(zip(rows, batch.column("base").to_pylist(), strict=True)):
                more = [{"start": c["start"], "kind": 3, "stop": c["stop"]} for k, c in enumerate(row) if best[i, k] >= network.threshold and not any(b["start"] <= c["start"] and c["stop"] <= b["stop"] for b in base)]
                out.append(sorted(base + more, key=lambda s: (s["start"], s["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(out, spans)], names=["doc_id", "base", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", network: CharNetwork | None = None) -> DataFrame:
    """doc_id, base and spans (start, kind number of KINDS, stop) of every document; trains a network unless one is given."""
    surveyed = stored(survey(docs, id_col, text_col), "candidates")
    network = network or learn(surveyed)
    schema = "doc_id long, base array<struct<start:long,kind:int,stop:long>>, spans array<struct<start:long,kind:int,stop:long>>"
    return surveyed.mapInArrow(_score(network), schema)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with all spans replaced."""
    out, at = [], 0
    for a, z in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join([*out, text[at:]])


def listed(spans: str) -> str:
    """SQL of the spans as kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.stop)), ',')"


ship_by_value(__name__)
