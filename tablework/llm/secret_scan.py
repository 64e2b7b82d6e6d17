"""Secret scan: fixed patterns plus character Markov models.

Three patterns give the base spans (assignments, access keys, long hex runs).
The method adds spans of kind ``markov``: two first-order character models,
one of random strings and one of ordinary identifiers, score every candidate
token by the log-likelihood ratio per character.

Both models are trained from a labelled sample that the patterns label: the
random class from at most ``TRAIN_SECRETS`` distinct secret values, the
ordinary class from the words of at most ``TRAIN_DOCS`` documents that are no
candidates themselves; both are taken by the smallest hash, so the sample is
repeatable.  Everything else
covers all rows and whole texts: one pass without a shuffle.

Candidates are maximal runs of ``[A-Za-z0-9+/_=-]``, cut at the base spans, of
``MIN_LENGTH`` characters or more.  One that passes as a whole, with a letter
and a digit, is a span.  In any other, the stretch of ``MIN_LENGTH`` characters
or more that lies highest above ``MIN_RATE`` is one if it passes and has a
letter, widened to the
ends of the letters and digits it is in and without joining characters at its
ends; what is left on both sides is searched
again.

Edge cases: null text counts as empty; an empty text has no spans and the
digest of the empty string; repeated rows are scanned one by one; null ids
pass through; without any secret in the sample the random model is uniform.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import id_and_text, map_texts, sample_rows

#: The base patterns (fixed values); letters of the first group in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
MIN_LENGTH = 16
#: Nats per character by which "random" must be likelier, and in all.
MIN_RATE, MIN_TOTAL = 0.2, 8.0
#: Share of an even distribution in each model: a random string may go on with
#: any character, an ordinary one seldom with a pair never seen.
RANDOM_UNIFORM, ORDINARY_UNIFORM = 0.5, 0.02
TRAIN_SECRETS = 4096
TRAIN_DOCS = 2048

_ASSIGN = re.compile(ASSIGN, re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
_HAS_DIGIT, _HAS_LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_CODE = np.zeros(128, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 1  # 0: start of the string

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>"


def _codes(token: str) -> np.ndarray:
    return np.concatenate(([0], _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]))


def transition_logs(tokens: list[str], uniform: float) -> np.ndarray:
    """Log-probabilities of one character after another: counted ones, mixed
    with the characters' shares where a character was never followed, and with
    ``uniform`` of an even distribution."""
    size = len(ALPHABET) + 1
    counts = np.zeros((size, size))
    for token in tokens:
        c = _codes(token)
        np.add.at(counts, (c[:-1], c[1:]), 1)
    even = np.full(size, 1 / size)
    shares = counts.sum(axis=0) / counts.sum() if counts.any() else even
    after = counts.sum(axis=1, keepdims=True)
    model = np.where(after > 0, counts / np.maximum(after, 1), shares)
    return np.log((1 - uniform) * model + uniform * even)


def train(docs: DataFrame, n_secrets: int = TRAIN_SECRETS, n_docs: int = TRAIN_DOCS) -> np.ndarray:
    """The table of log-likelihood ratios, random against ordinary."""
    base = id_and_text(docs)
    pattern = f"({ACCESS}|{HEX})"
    secret = base.where(F.col("text").rlike(pattern)).select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("token"))
    secret = secret.select(F.substring("token", 1, 256).alias("token")).distinct()
    random = [r.token for r in secret.orderBy(F.xxhash64("token"), "token").limit(n_secrets).collect()]
    words = (
        sample_rows(base, n_docs)
        .select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9+/_=-]{2,64})"), F.lit(1)))).alias("token"))
        .where(~F.col("token").rlike(pattern)).where(F.col("token").rlike("[A-Za-z]"))
        .where((F.length("token") < MIN_LENGTH) | ~F.col("token").rlike("[0-9]"))  # a candidate has no label yet
    )
    ordinary = [r.token for r in words.distinct().orderBy(F.xxhash64("token"), "token").limit(50 * n_secrets).collect()]
    return transition_logs(random, RANDOM_UNIFORM) - transition_logs(ordinary, ORDINARY_UNIFORM)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three patterns, code points."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _best_stretch(gain: np.ndarray) -> tuple[int, int] | None:
    """(start, end) of the ``MIN_LENGTH`` or more characters whose gain lies
    highest above ``MIN_RATE``, if they pass both limits."""
    total = np.concatenate(([0.0], np.cumsum(gain - MIN_RATE)))
    before = total[: len(total) - MIN_LENGTH]
    above = total[MIN_LENGTH:] - np.minimum.accumulate(before)
    end = int(np.argmax(above)) + MIN_LENGTH
    start = int(np.argmin(before[: end - MIN_LENGTH + 1]))
    good = above[end - MIN_LENGTH] >= 0 and gain[start:end].sum() >= MIN_TOTAL
    return (start, end) if good else None


def markov_spans(text: str, ratio: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out, joints = [], "+/_=-"
    for m in _CANDIDATE.finditer(text):
        pieces, at = [], m.start()
        for s, _, e in [t for t in taken if t[0] < m.end() and m.start() < t[2]]:
            pieces.append((at, s))
            at = max(at, e)
        pieces.append((at, m.end()))
        while pieces:
            lo, hi = pieces.pop()
            if hi - lo < MIN_LENGTH:
                continue
            token = text[lo:hi]
            c = _codes(token)
            gain = ratio[c[:-1], c[1:]]
            score = float(gain.sum())
            if _HAS_DIGIT.search(token) and _HAS_LETTER.search(token) and score >= MIN_TOTAL and score >= MIN_RATE * len(token):
                out.append((lo, 3, hi))
                continue
            found = _best_stretch(gain)
            if found is None:
                continue
            start, end = found
            if not token[start:end].strip(joints):
                pieces += [(lo, lo + start), (lo + end, hi)]
                continue
            start += len(token[start:end]) - len(token[start:end].lstrip(joints))
            end = start + len(token[start:end].rstrip(joints))
            while start and token[start] not in joints and token[start - 1] not in joints:
                start -= 1
            while end < len(token) and token[end - 1] not in joints and token[end] not in joints:
                end += 1
            if _HAS_LETTER.search(token[start:end]):  # plain numbers are no secrets
                out.append((lo + start, 3, lo + end))
            pieces += [(lo, lo + start), (lo + end, hi)]
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, ratio: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts by kind, digest of the base spans,
    all spans as text and as structs (code points, end exclusive)."""
    source = id_and_text(docs, id_col, text_col)
    model = train(source) if ratio is None else ratio

    def run(ids: list, texts: list[bytes]) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans", "found")}
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            every = sorted(base + markov_spans(text, model, base))
            for i, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(1 for _, k, _ in every if k == i))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(every))
            out["found"].append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
        return out | {"doc_id": ids}

    return map_texts(source, run, SCHEMA)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found in ``text`` replaced by ``mask``; where
    spans overlap, their union is replaced once.  Other columns stay, and
    ``n_chars`` is recomputed where there is one.  A null text stays null."""
    model = train(docs)
    names = docs.columns
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        at = names.index("text")
        for batch in batches:
            texts, changed = batch.column(at).to_pylist(), {}
            for i, text in enumerate(texts):
                if not text:
                    continue
                base = base_spans(text)
                spans = sorted((s, e) for s, _, e in base + markov_spans(text, model, base))
                if spans:
                    parts, done = [], 0
                    for s, e in spans:
                        if s >= done:
                            parts += [text[done:s], mask]
                        done = max(done, e)
                    changed[i] = "".join(parts) + text[done:]
            if changed:
                texts = [changed.get(i, t) for i, t in enumerate(texts)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))
                if "n_chars" in names:
                    k = names.index("n_chars")
                    was = batch.column(k).to_pylist()
                    batch = batch.set_column(k, batch.schema.field(k), pa.array([len(texts[i]) if i in changed else w for i, w in enumerate(was)], type=batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(run, schema)
