"""Quality rules: fixed base rules, and a learned decision list.

Sequential covering grows conjunctions of thresholds over the statistics by
information gain on two thirds of the labelled rows, for rejecting and for
accepting; prunes them on the rest, and keeps those precise there. Rows that an
imprecise rule covers are set aside and the search goes on without them. The
list becomes one ordered Spark conditional: the first rule that fits decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtok.llm.labelled import SAMPLE, labelled_sample

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Of the bytes of a text: upper-case letters, digits, marks that end sentences, bangs, bars; lines, and distinct words.
MORE = ("n_upper", "n_digits", "n_stops", "n_bangs", "n_bars", "n_lines", "n_kinds")
COUNTS = BASE + MORE
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
_UPPER, _DIGITS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".?"
#: How precise a rule must be that rejects, and one that accepts; rules of a list, tests of a rule, rows it must cover apart, and imprecise rules borne.
REJECTS, ACCEPTS, RULES, TESTS, COVER, TRIES = 0.9, 0.98, 24, 4, 3, 12


def repeated(words: list[bytes], size: int = 3) -> int:
    """Words in windows of three that the text has twice or more."""
    if len(words) <= size:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter(map(ids.setdefault, words, count()), np.int64, len(words))
    key = w[: len(w) - size + 1]
    for k in range(1, size):
        if len(words) >= 1 << 21 and k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * (len(words) if len(words) >= 1 << 21 else 1 << 21) + w[k : len(w) - size + 1 + k]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = n[at] > 1
    covered = np.zeros(len(w), bool)
    for k in range(size):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words, lines, again = raw.split(), set(), 0
    for line in raw.split(b"\n"):
        if line in lines:
            again += bool(line.strip())
        lines.add(line)
    base = len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), again, repeated(words)
    apart = (len(raw) - len(raw.translate(None, x)) for x in (_UPPER, _DIGITS, _STOPS))
    return *base, *apart, raw.count(b"!"), raw.count(b"|"), raw.count(b"\n") + 1, len(set(words))


def text_counts(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, the columns named, and the counts of each row; null texts have none of anything."""
    kind = docs.select("doc_id", *also).schema
    for c in COUNTS:
        kind = kind.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(x) for x in batch.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *also)), *(pa.array(c) for c in rows.T.copy())], names=kind.names)

    return docs.select("doc_id", *also, "text").mapInArrow(run, kind)


def ratios(c: dict) -> dict:
    """What thresholds are put on, from counts as columns or arrays."""
    n = c["n_words"] + 1
    shares = {"symbol": "n_symbols", "dup_line": "n_dup_lines", "repeat": "n_repeat_words", "upper": "n_upper", "digit": "n_digits", "stop": "n_stops", "bang": "n_bangs", "bar": "n_bars", "line": "n_lines", "kind": "n_kinds"}
    return {"n_words": c["n_words"] * 1.0, "word_length": c["word_chars"] / n, **{f"{k}_share": c[v] / n for k, v in shares.items()}}


Test = tuple[str, bool, float]
#: What a rule asks, and whether it keeps what fits.
Rule = tuple[list[Test], bool]


def _met(tests: list[Test], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, above, cut in tests:
        out &= (x[name] > cut) == above
    return out


def _grow(x: dict[str, np.ndarray], wanted: np.ndarray, rows: np.ndarray) -> list[Test]:
    """Tests that set wanted rows apart from the others, the one of most gain first."""
    inside, tests = rows.copy(), []
    while (neg := (inside & ~wanted).sum()) and (pos := (inside & wanted).sum()) and len(tests) < TESTS:
        base, best = np.log2(pos / (pos + neg)), (0.0, None)
        for name, v in x.items():
            for cut in np.unique(np.quantile(v[inside], np.linspace(0.02, 0.98, 49))):
                for above in (False, True):
                    now = inside & ((v > cut) == above)
                    if p := (now & wanted).sum():
                        gain = p * (np.log2(p / now.sum()) - base)
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, above, float(cut)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= _met(tests[-1:], x)
    return tests


def _prune(tests: list[Test], x: dict[str, np.ndarray], wanted: np.ndarray, rows: np.ndarray) -> list[Test]:
    """The beginning of the tests that is worth most on rows kept apart."""

    def worth(tests: list[Test]) -> float:
        now = rows & _met(tests, x)
        p, n = (now & wanted).sum(), (now & ~wanted).sum()
        return (p - n) / max(1, p + n)

    while len(tests) > 1 and (shorter := max((tests[:k] for k in range(1, len(tests))), key=worth)) and worth(shorter) >= worth(tests):
        tests = shorter
    return tests


def learn(x: dict[str, np.ndarray], reject: np.ndarray) -> list[Rule]:
    """An ordered list of conjunctions that reject or accept; those that reject are sought first, and what no rule fits is kept."""
    fold = np.arange(len(reject)) % 3 == 2
    open_rows, aside, rules, tries = np.ones(len(reject), bool), np.zeros(len(reject), bool), [], 0
    while len(rules) < RULES and tries < TRIES and (open_rows & reject).any():
        before = len(rules)
        for keep, wanted, precise in ((False, reject, REJECTS), (True, ~reject, ACCEPTS)):
            tests = _grow(x, wanted, open_rows & ~fold & ~aside)
            if not tests:
                continue
            tests = _prune(tests, x, wanted, open_rows & fold)
            met = _met(tests, x)
            got = open_rows & fold & met
            if got.sum() >= COVER and (got & wanted).sum() >= precise * got.sum():
                rules.append((tests, keep))
                open_rows &= ~met
                break
            if not keep:
                failed = met
        else:
            tries += 1
            if not (open_rows & ~fold & ~aside & reject).any():
                break
            aside |= failed
        if len(rules) == before and aside.all():
            break
    while rules and rules[-1][1]:  # the default keeps as well
        rules.pop()
    return rules


def verdict(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """What the first rule that fits says; true where none does."""
    out = F.when(F.lit(False), F.lit(False))
    for tests, keep in rules:
        met = F.lit(True)
        for name, above, cut in tests:
            met = met & (columns[name] > cut if above else columns[name] <= cut)
        out = out.when(met, F.lit(keep))
    return out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_rules(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[Rule]:
    """Learns from those of labelled_sample() that the base rules keep; too few, or one class, give an empty list, which keeps all."""
    rows = text_counts(labelled_sample(docs, labels, "quality", most), "y").where(~base_failed()).toPandas().sort_values(["doc_id", *COUNTS])
    reject = rows.y.to_numpy() == 0
    if len(rows) < 50 or reject.all() or not reject.any():
        return []
    order = np.random.default_rng(0).permutation(len(rows))
    return learn({k: np.asarray(v, float)[order] for k, v in ratios({c: rows[c].to_numpy(float) for c in COUNTS}).items()}, reject[order])


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five base counts, base_failed, kept and the other counts for each row of docs.

    A null or empty text has no words and fails the base rules; rows with the
    same or a null id are judged each; no rows give no rows; other columns of
    docs are ignored.
    """
    rules = fit_rules(docs, labels)
    out = text_counts(docs).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & verdict(rules, ratios({c: F.col(c) for c in COUNTS}))
    return out.select("doc_id", *BASE, "base_failed", kept.alias("kept"), *MORE)
