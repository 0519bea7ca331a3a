"""Operator 4, secret scans: a character convolutional network over every candidate and the text around it."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import batched, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnlight.llm.common import quoted, read

#: Characters seen before a candidate, of it and after it, and in all. Of a longer one a window begins every STRIDE characters.
BEFORE, INSIDE, AFTER = 40, 48, 12
STRIDE = INSIDE // 2
WIDTH = BEFORE + INSIDE + AFTER
#: Labelled findings that are drawn, and how they are shared out among training, calibration and test.
FINDINGS, SHARES, SEED = 9_000, (0.6, 0.2, 0.2), 4
#: The threshold is the highest that keeps this share of the true findings set aside for calibration.
MIN_RECALL = 0.995
EMBED, FILTERS, KERNEL, HIDDEN, EPOCHS, BATCH, RATE = 8, 32, 5, 16, 6, 64, 0.004
MASK = "[SECRET]"

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 \n\"'=:;,.<>()[]{}-_/+#@$%&*!?|\\"
#: 0 is nothing, 1 any other character; capitals follow the alphabet.
CODES = {c: i + 2 for i, c in enumerate(ALPHABET)} | {chr(65 + i): len(ALPHABET) + 2 + i for i in range(26)}
SIZE = len(ALPHABET) + 28

RUN = re.compile(r"[A-Za-z0-9_+/\-]{16,}(?:\.[A-Za-z0-9_+/\-]{6,})*={0,2}")
PART = re.compile(r"[^/]{16,}")
SIGN = re.compile(r"[=:]")
NAME = re.compile(r"(?:password|passwd|passphrase|pwd|secret|token|credential|api[_-]?key|access[_-]?key|auth|private[_-]?key)[A-Za-z0-9_\-]{0,20}[\"']?$", re.IGNORECASE)
VALUE = re.compile(r"\s*+(?:[\"']([^\"'\n]{6,})[\"']|([^\s\"',;<>]{6,}))")
BEGIN = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
END = re.compile(r"-----END [A-Z ]{0,30}PRIVATE KEY-----")
DIGIT = re.compile(r"[0-9]")
MIXED = re.compile(r"[a-z][A-Z]")


def _key_like(run: str) -> bool:
    return bool(DIGIT.search(run)) or (len(run) >= 20 and bool(MIXED.search(run)))


def key_blocks(text: str) -> list[tuple[int, int]]:
    """From each BEGIN line to the next END line, however far, or the BEGIN line alone where none follows."""
    ends, out = [m.end() for m in END.finditer(text)], []
    for m in BEGIN.finditer(text):
        if not out or m.start() >= out[-1][1]:
            k = bisect_right(ends, m.end())
            out.append((m.start(), ends[k] if k < len(ends) else m.end()))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be a secret, in order, a longer one before those inside it: key blocks, values given to a telling name,
    long runs of key characters with a digit or, from 20 on, a capital after a small letter, and such parts of a run between
    slashes."""
    spans = key_blocks(text) if "-----BEGIN" in text else []
    for m in RUN.finditer(text):
        if _key_like(m.group()):
            spans.append(m.span())
            if "/" in m.group():
                spans += [(m.start() + x.start(), m.start() + x.end()) for x in PART.finditer(m.group()) if _key_like(x.group())]
    for m in SIGN.finditer(text):
        at = m.start()
        while at and text[at - 1].isspace():
            at -= 1
        if NAME.search(text[max(0, at - 45) : at]):
            value = VALUE.match(text, m.end())
            if value:
                spans.append(value.span(1) if value.group(1) else value.span(2))
    return sorted(set(spans), key=lambda s: (s[0], -s[1]))


def windows(start: int, end: int) -> list[int]:
    """Where the windows begin that together see the whole candidate."""
    return [*range(start, end - INSIDE, STRIDE), max(start, end - INSIDE)]


def codes(text: str, start: int, end: int, at: int | None = None) -> np.ndarray:
    """One candidate as the network sees it, by its window from at on (its beginning, if not given)."""
    out = np.zeros(WIDTH, np.uint8)
    at = start if at is None else at
    inside = text[at : min(end, at + INSIDE)]
    for to, part in ((BEFORE - min(start, BEFORE), text[max(0, start - BEFORE) : start]), (BEFORE, inside), (BEFORE + INSIDE, text[end : end + AFTER])):
        out[to : to + len(part)] = [CODES.get(c, 1) for c in part]
    return out


_SMALL = "the of and a to in is was for on with that de la el que y en los un der die und das ist le les et des une".split()


def _prose(rng: random.Random, n: int) -> str:
    made = lambda: "".join(rng.choice("er on an th re in en at es ou nt ti ha ca so mi lle que ung sch ção ñe é eau".split()) for _ in range(rng.randint(1, 5)))
    out = [rng.choice(_SMALL) if rng.random() < 0.45 else made() for _ in range(n)]
    return " ".join(w.capitalize() + rng.choice(["", ",", ".", ""]) if rng.random() < 0.12 else w for w in out)


def _upper(text: str) -> str:
    return "".join(c.upper() if len(c.upper()) == 1 else c for c in text)


def _chars(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """n labelled findings (text, start, end, 1 for a secret), drawn from the public formats of credentials and of what looks like them."""
    rng = random.Random(seed)
    hexed, letters, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed = letters + digits
    names = ["token", "TOKEN", "api_key", "apiKey", "API-KEY", "secret", "client_secret", "password", "passwd", "auth_token", "access_key", "private_key", "credential", "pwd", "db_password", "AUTH"]
    signs = [' = "{}"', ": {}", "={}", ' := "{}"', '": "{}"', " = '{}'", "='{}'"]
    strong = [
        lambda: _chars(rng, hexed, rng.choice([32, 40, 64])),
        lambda: _chars(rng, mixed, rng.randint(20, 48)),
        lambda: _chars(rng, mixed + "+/", 40),
        lambda: _chars(rng, mixed + "-_", rng.randint(24, 64)),
        lambda: _chars(rng, mixed + "!@#$%&*", rng.randint(10, 20)),
    ]
    known = [
        lambda: "AKIA" + _chars(rng, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
        lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + _chars(rng, mixed, 36),
        lambda: "xoxb-" + _chars(rng, digits, 12) + "-" + _chars(rng, mixed, 24),
        lambda: rng.choice(["sk_live_", "rk_live_"]) + _chars(rng, mixed, 24),
        lambda: "AIza" + _chars(rng, mixed + "-_", 35),
        lambda: "eyJ" + _chars(rng, mixed, 30) + "." + "eyJ" + _chars(rng, mixed, 40) + "." + _chars(rng, mixed + "-_", 43),
        lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + _chars(rng, mixed + "+/", 64) + "\n" + _chars(rng, mixed + "+/", 64) + "\n-----END RSA PRIVATE KEY-----",
    ]
    dull = [
        lambda: ("", rng.choice("45") + _chars(rng, digits, 15)),
        lambda: (rng.choice(["", "order ", "id ", "No. "]), _chars(rng, digits, rng.randint(16, 22))),
        lambda: (rng.choice(["commit ", "sha256:", "md5 ", "digest: ", "checksum ", "revision "]), _chars(rng, hexed, rng.choice([32, 40, 64]))),
        lambda: (rng.choice(["id: ", "uuid ", ""]), "-".join(_chars(rng, hexed, x) for x in (8, 4, 4, 4, 12))),
        lambda: ("https://example.com/", "/".join(_prose(rng, 1).lower().replace(" ", "") + _chars(rng, digits, 3) for _ in range(4))),
        lambda: ("data:image/png;base64,", "iVBORw0KGgo" + _chars(rng, mixed + "+/", 60)),
        lambda: ("", "-".join(_prose(rng, 1).strip(",.").lower() for _ in range(4)) + "-" + _chars(rng, digits, 2)),
        lambda: ("", "_".join(_prose(rng, 1).strip(",.").lower() for _ in range(4)) + _chars(rng, digits, 1)),
        lambda: ("", "".join(_prose(rng, 1).strip(",.").capitalize() for _ in range(5))),
        lambda: ("", "20" + _chars(rng, digits, 2) + "-0" + _chars(rng, "123456789", 1) + "-1" + _chars(rng, digits, 1) + "T12-30-" + _chars(rng, digits, 2)),
        lambda: (rng.choice(names) + rng.choice([" = ", ": ", "="]), rng.choice(["your-token-here-123", "changeme", "xxxxxxxxxxxxxxxxxxxx", "example", "placeholder", "undefined", "required", "${API_KEY_1}", "os.environ", "************", "<your_key>"])),
        lambda: (rng.choice(names) + ": ", _prose(rng, 1).strip(",.").lower() + "ation"),
        # longer than a window
        lambda: (rng.choice(names) + rng.choice(["_note", "", "_help"]) + rng.choice([': "', ' = "', '="']), _prose(rng, rng.randint(8, 40))),
        lambda: ("", "/" + "/".join("-".join(_prose(rng, 1).strip(",.").lower() for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "-" + _chars(rng, digits, 1)]) for _ in range(rng.randint(3, 8)))),
    ]
    out = []
    while len(out) < n:
        label = len(out) % 2
        if label:
            if rng.random() < 0.7:
                head, value, tail = rng.choice(names), rng.choice(strong)(), ""
                head, tail = (head + rng.choice(signs)).split("{}")
            else:
                head, value, tail = "", rng.choice(known)(), ""
        else:
            (head, value), tail = rng.choice(dull)(), ""
        left, right = _prose(rng, rng.randint(0, 9)), _prose(rng, rng.randint(0, 5))
        gap = rng.choice([" ", " ", "\n", "### ", " ("])
        if rng.random() < 0.15:  # shouting, with noise
            left, right, head, gap = (_upper(t) for t in (left.replace(" ", "!! "), right, head, rng.choice(["!! ", "%%% ", "### ", gap])))
            value = _upper(value) if value[:1].isdigit() or rng.random() < 0.5 else value
        text = left + gap + head + value + tail + rng.choice([" ", "\n", ". ", "$$$ ", "!! ", "%%% "]) + right
        start = len(left) + len(gap) + len(head)
        out.append((text, start, start + len(value), label))
    return out


@dataclass
class Network:
    """Embedding, one convolution, the greatest response before, inside and after the candidate, two dense layers; then Platt's scale."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        e = w["embed"][x]
        wide = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - KERNEL + 1, KERNEL * EMBED)
        c = np.maximum(wide @ w["conv"] + w["conv_b"], 0)
        parts, at = [], []
        for a, b in ((0, BEFORE), (BEFORE, BEFORE + INSIDE - KERNEL), (BEFORE + INSIDE - KERNEL, WIDTH - KERNEL + 1)):
            k = c[:, a:b].argmax(axis=1) + a
            at.append(k)
            parts.append(np.take_along_axis(c, k[:, None, :], axis=1)[:, 0])
        mean = c[:, BEFORE : BEFORE + INSIDE - KERNEL].mean(axis=1)
        pooled = np.concatenate([*parts, mean], axis=1)
        h = np.maximum(pooled @ w["dense"] + w["dense_b"], 0)
        return (h @ w["out"] + w["out_b"])[:, 0], (x, wide, c, at, pooled, h)

    def backward(self, cache: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
        w, (x, wide, c, at, pooled, h) = self.weights, cache
        g = {"out": h.T @ d[:, None], "out_b": d.sum(keepdims=True)}
        dh = (d[:, None] @ w["out"].T) * (h > 0)
        g |= {"dense": pooled.T @ dh, "dense_b": dh.sum(axis=0)}
        dp = dh @ w["dense"].T
        dc = np.zeros_like(c)
        rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for i, k in enumerate(at):
            dc[rows, k, filters] += dp[:, i * FILTERS : (i + 1) * FILTERS]
        inner = slice(BEFORE, BEFORE + INSIDE - KERNEL)
        dc[:, inner] += dp[:, 3 * FILTERS :][:, None, :] / (INSIDE - KERNEL)
        dc *= c > 0
        g |= {"conv": np.tensordot(wide, dc, ([0, 1], [0, 1])), "conv_b": dc.sum(axis=(0, 1))}
        dw = (dc @ w["conv"].T).reshape(len(x), -1, KERNEL, EMBED)
        de = np.zeros((len(x), WIDTH, EMBED), np.float32)
        for k in range(KERNEL):
            de[:, k : k + dw.shape[1]] += dw[:, :, k]
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], x, de)
        return g

    def probability(self, x: np.ndarray) -> np.ndarray:
        logits = np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40)))


def train(findings: list[tuple[str, int, int, int]], seed: int = SEED, min_recall: float = MIN_RECALL) -> tuple[Network, dict[str, float]]:
    """A network trained, calibrated and given its threshold on labelled findings, and how it does on those it never saw."""
    rng = np.random.default_rng(seed)
    views = [[codes(t, a, b, at) for at in windows(a, b)] for t, a, b, _ in findings]
    x, first = np.stack([v for some in views for v in some]), np.cumsum([0, *map(len, views)])
    y = np.array([label for *_, label in findings], np.float32)
    order = rng.permutation(len(y))
    cut = np.cumsum([int(len(y) * s) for s in SHARES[:2]])
    fit, tune, test = np.split(order, cut)
    # a finding is judged by its most suspicious window; while training each window counts
    seen = lambda rows: x[np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])]
    best = lambda values, rows: np.maximum.reduceat(values, np.cumsum([0, *np.diff(first)[rows][:-1]]))
    owner = np.repeat(np.arange(len(y)), np.diff(first))
    fit = np.flatnonzero(np.isin(owner, fit))
    normal = lambda *shape: (rng.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
    net = Network(
        {
            "embed": (rng.standard_normal((SIZE, EMBED)) * 0.3).astype(np.float32),
            "conv": normal(KERNEL * EMBED, FILTERS),
            "conv_b": np.zeros(FILTERS, np.float32),
            "dense": normal(4 * FILTERS, HIDDEN),
            "dense_b": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, 1),
            "out_b": np.zeros(1, np.float32),
        }
    )
    (m, v), step = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2)), 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for a in range(0, len(fit), BATCH):
            rows = fit[a : a + BATCH]
            logits, cache = net.forward(x[rows])
            grads = net.backward(cache, (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y[owner[rows]]) / len(rows))
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.weights[k] = (net.weights[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    view = seen(tune)
    logits = best(np.concatenate([net.forward(view[i : i + 512])[0] for i in range(0, len(view), 512)]), tune)
    # Platt: targets a little inside 0 and 1, Newton's steps
    up, down = y[tune].sum(), len(tune) - y[tune].sum()
    target = np.where(y[tune] > 0, (up + 1) / (up + 2), 1 / (down + 2))
    design, beta = np.stack([logits, np.ones_like(logits)], axis=1).astype(np.float64), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        beta -= np.linalg.solve(hessian, design.T @ (p - target) + 1e-6 * beta)
    net.scale, net.shift = float(beta[0]), float(beta[1])
    true = np.sort(best(net.probability(view), tune)[y[tune] > 0])
    net.threshold = float(true[int(len(true) * (1 - min_recall))]) * (1 - 1e-6)
    p = best(net.probability(seen(test)), test)
    said = p >= net.threshold
    return net, {"recall": float(said[y[test] > 0].mean()), "precision": float(y[test][said].mean()), "brier": float(((p - y[test]) ** 2).mean())}


@lru_cache(maxsize=2)
def default_network() -> Network:
    return train(labelled_findings())[0]


def scan(network: Network, texts: list[str | None]) -> list[list[tuple[int, int, float]]]:
    """For each text its candidates (start, end, probability of the most suspicious window), the whole of each having been seen.

    Only then is one inside another left out, where the other is judged a secret or it is none itself.
    """
    spans = [candidates(t) if t else [] for t in texts]
    views = ((t, a, b, at) for t, s in zip(texts, spans) for a, b in s for at in windows(a, b))
    p = (x for part in batched(views, 4096) for x in network.probability(np.stack([codes(*v) for v in part])).tolist())
    out = []
    for s in spans:
        kept: list[tuple[int, int, float]] = []
        reach = secret_reach = -1
        for a, b in s:
            best = max(islice(p, len(windows(a, b))))
            secret = best >= network.threshold
            # of those before, the farthest end: they begin no later
            if b > reach or (secret and b > secret_reach):
                kept.append((a, b, best))
            reach, secret_reach = max(reach, b), max(secret_reach, b) if secret else secret_reach
        out.append(kept)
    return out


def find_secrets(docs: DataFrame, row_id: str = "doc_id", text: str = "text", network: Network | None = None) -> DataFrame:
    """(doc_id, start_char, end_char, probability, is_secret, digest) for every candidate of every text, in the whole of it.

    start_char and end_char count characters; digest is the SHA-256 of the candidate, which itself isn't repeated. Null and
    empty texts have no candidates; null and repeated ids are kept, each row is scanned for itself. A candidate longer than
    the network's view is judged by its most suspicious window; one inside another is listed where only it is a secret.
    """
    net = network or default_network()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                texts = b.column(1).slice(a, 500).to_pylist()
                found = scan(net, texts)
                at = [i for i, spans in enumerate(found) for _ in spans]
                flat = [s for spans in found for s in spans]
                if flat:
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).slice(a, 500).take(pa.array(at)),
                            pa.array([s[0] for s in flat], pa.int64()),
                            pa.array([s[1] for s in flat], pa.int64()),
                            pa.array([s[2] for s in flat], pa.float64()),
                            pa.array([s[2] >= net.threshold for s in flat]),
                            pa.array([hashlib.sha256(texts[i][s[0] : s[1]].encode()).hexdigest() for i, s in zip(at, flat)]),
                        ],
                        names=["doc_id", "start_char", "end_char", "probability", "is_secret", "digest"],
                    )

    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(quoted(row_id), quoted(text)).mapInArrow(run, f"doc_id {kind}, start_char long, end_char long, probability double, is_secret boolean, digest string")


def mask_secrets(docs: DataFrame, text: str = "text", network: Network | None = None, mask: str = MASK) -> DataFrame:
    """docs with each secret in the text replaced by mask; rows and other columns as they were, n_chars, if there is one, follows.

    Null and empty texts stay as they are, texts may be of any length, repeated rows are masked alike; secrets that overlap
    are one. Columns may have any names.
    """
    net = network or default_network()
    names = docs.columns
    at, size = names.index(text), names.index("n_chars") if "n_chars" in names and text == "text" else None

    def masked(t: str | None, spans: list[tuple[int, int, float]]) -> str | None:
        done, out = 0, []
        for a, b, p in spans:
            if p >= net.threshold:
                out += [t[done : max(a, done)], mask] if a >= done else []
                done = max(done, b)
        return "".join([*out, t[done:]]) if out else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                texts = part.column(at).to_pylist()
                new = [masked(t, s) for t, s in zip(texts, scan(net, texts))]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.column(at).type)
                if size is not None:
                    old = part.column(size)
                    columns[size] = pa.array([o if t is n or n is None else len(n) for o, t, n in zip(old.to_pylist(), texts, new)], old.type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))
