"""Personal data: high-recall generators propose overlapping spans, boosted trees judge them.

Base spans follow fixed formats and stay whatever the trees say. Wider generators (long tokens with digits, loose
number runs, account numbers, dates) propose more; gradient-boosted trees over format and context features score
these, and a span is added where its score passes its kind's threshold, calibrated on held-out examples.

No labelled personal data exist here, so the trees learn from seeded examples whose label is known because they
were made: values of kinds that are personal and of kinds that look alike but aren't (identifiers, digests of
files, versions, prices, days of publication), with and without a cue before them, each put into surroundings taken
from a bounded sample of the documents. No feature holds the label, and a table's size doesn't change what is learned.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, least_hashed, prepare, saved

# Fixed formats, in the order in which kinds are listed.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
#: Kinds that generators propose and the trees judge; a secret is a key or password, born a day of birth.
JUDGED = ("secret", "number", "account", "born")
KINDS = BASE + JUDGED

_DIGIT = re.compile(r"[0-9]")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+@-]*")
_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_NUMBER = re.compile(r"[+(]?[0-9][0-9().\x20-]{6,}[0-9]")
_GROUPED = re.compile(r"(?<![0-9])(?:(?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_DATE = re.compile(r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])")
#: Words of the 32 characters before a span, by what they speak for.
_CUES = [
    re.compile(p, re.I)
    for p in (
        r"token|secret|passw|auth|credential|bearer|api|key\b",
        r"phone|mobile|\btel\b|fax|call|ssn|social security|contact",
        r"iban|account|bank|acct",
        r"\bborn|birth|\bdob\b",
        r"order|\bref|invoice|version|release|page|isbn|item|commit|digest|checksum|file|build|part|serial|\bid\b",
        r"publish|updat|posted|dated|since|until|printed",
    )
]
_ADDRESS_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-@")

#: Surroundings that are taken from the documents, at most: those whose hash is least. One a document.
CONTEXTS = 4_000
#: Examples of each judged kind and label; a quarter is held out to calibrate thresholds.
EXAMPLES = 3_000
PRECISION = 0.99


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        # a run of zeros may be longer than int() reads
        return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in s.split("."))
    digits = re.sub(r"[^0-9]", "", s)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def proposals(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, valid): matches of the fixed formats, and with valid False also what only looks like one."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        # a match lies within the run of address characters around an @
        begin, end = at, at
        while begin > done and text[begin - 1] in _ADDRESS_CHARS:
            begin -= 1
        end = _ADDRESS.match(text, at).end()
        found += [("email", m.start(), m.end(), True) for m in EMAIL.finditer(text, begin, end)]
        done = end
        at = text.find("@", end)
    if not _DIGIT.search(text):
        return found
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            if (ok := _valid(kind, m[0])) or kind != "card" or m.end() - m.start() >= 8:
                found.append((kind, m.start(), m.end(), ok))
    for m in _TOKEN.finditer(text):
        if _DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0]):
            found.append(("secret", m.start(), m.end(), False))
    loose = {(m.start(), m.end()) for p in (_NUMBER, _GROUPED) for m in p.finditer(text)}
    found += [("number", s, e, False) for s, e in sorted(loose)]
    for kind, pattern in (("account", _ACCOUNT), ("born", _DATE)):
        found += [(kind, m.start(), m.end(), False) for m in pattern.finditer(text)]
    return found


def _check_digits(s: str) -> bool:
    """Whether an account number's check digits are right (ISO 7064, 97-10)."""
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate; a context is the 32 characters before and the two after it."""
    s, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 2]
    n, digits = len(s), "".join(_DIGIT.findall(s))
    letters = [c for c in s if c.isalpha()]
    counts = Counter(s)
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    octets = re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s) is not None and _valid("ip", s)
    runs = [len(x) for x in re.findall("[0-9]+|[A-Z]+|[a-z]+", s)] or [0]
    return [
        float(KINDS.index(kind)), n, len(digits), len(digits) / n, sum(c.isupper() for c in s) / n, sum(c in "0123456789abcdefABCDEF" for c in s) / n,
        counts["."], counts["-"], counts[" "], counts["("], counts["_"], float(s[0] == "+"), float(12 <= len(digits) <= 19 and luhn(digits)), float(octets),
        entropy, float(before.rstrip(" \"'")[-1:] in "=:" and bool(before.strip())), float(before[-1:] in "\"'" and before != ""),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(len(set(digits)) <= 2), float(_GROUPED.fullmatch(s) is not None),
        len(runs) / n, max(runs), len(counts) / n, sum(c in "aeiouAEIOU" for c in letters) / max(1, len(letters)), float(kind == "account" and _check_digits(s)),
        *(float(p.search(before) is not None) for p in _CUES),
    ]


# ---- examples -----------------------------------------------------------------------------------

_HEX, _LOWER, _UPPER, _DIGITS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _LOWER + _UPPER + _DIGITS
_SYLLABLES = ("re", "port", "sec", "tion", "mod", "el", "user", "pro", "file", "ta", "ble", "in", "dex", "ver", "sion", "con", "fig", "data", "set", "over", "view", "map")


def _word(r: random.Random) -> str:
    return "".join(r.choices(_SYLLABLES, k=r.randint(2, 3)))


def _number_like(r: random.Random, shape: str) -> str:
    """shape with each 9 a digit and each 8 a digit from 2 on."""
    return "".join(r.choice(_DIGITS) if c == "9" else r.choice("23456789") if c == "8" else c for c in shape)


def _day(r: random.Random) -> str:
    y, m, d = r.randint(1930, 2024), r.randint(1, 12), r.randint(1, 28)
    return r.choice([f"{y}-{m:02}-{d:02}", f"{d:02}/{m:02}/{y}", f"{d}.{m}.{y}", f"{m}-{d}-{y}"])


def _account(r: random.Random, right: bool) -> str:
    body = "".join(r.choices(_DIGITS + _UPPER[:4] * r.randint(0, 1), k=r.choice([12, 16, 18, 20])))
    land = r.choice(_UPPER) + r.choice(_UPPER)
    check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    whole = f"{land}{check if right else (check + r.randint(1, 90)) % 97 + 2:02}{body}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if r.random() < 0.5 else whole


def _value(r: random.Random, kind: str, personal: bool) -> tuple[str, str]:
    """(cue, value) of an example; the cue may be empty."""
    mark = r.choice([": ", " = ", "=", ' = "', ": '", " "])
    if kind == "secret" and personal:
        value = r.choice(
            [
                lambda: "".join(r.choices(_HEX, k=r.choice([32, 40, 64]))),
                lambda: "".join(r.choices(_ALNUM + "+/", k=r.randint(20, 44))),
                lambda: r.choice(["sk_live_", "pk_", "ghp_", "xoxb-", ""]) + "".join(r.choices(_ALNUM, k=r.randint(20, 36))),
                lambda: "".join(r.choices(_UPPER + _DIGITS, k=20)),
            ]
        )()
        return (r.choice(["token", "api key", "api_key", "password", "secret", "auth", "access key", "Bearer", "credentials"]) + mark if r.random() < 0.7 else ""), value
    if kind == "secret":
        value = r.choice(
            [
                lambda: "-".join("".join(r.choices(_HEX, k=k)) for k in (8, 4, 4, 4, 12)),
                lambda: "_".join([_word(r), _word(r), str(r.randint(1, 2030)), _word(r)]),
                lambda: "-".join([_word(r), str(r.randint(1, 99)), _word(r), _word(r)]),
                lambda: "".join(_word(r).title() for _ in range(3)) + str(r.randint(1, 2030)),
                lambda: "/".join([_word(r), _word(r), str(r.randint(1, 999)), _word(r)]),
                lambda: r.choice(_LOWER) * r.randint(16, 24) + r.choice(_DIGITS),
                lambda: "".join(r.choices(_HEX, k=40)),
            ]
        )()
        digest = all(c in _HEX for c in value) and len(value) == 40
        return (r.choice(["commit", "digest", "file", "checksum"]) + mark if digest else r.choice(["id", "file", "page", "ref", "part", "version"]) + mark if r.random() < 0.4 else ""), value
    if kind == "number" and personal:
        shape = r.choice(["(899) 899-9999", "899-899-9999", "899.899.9999", "1 899 899 9999", "+1 (899) 899-9999", "899 899 9999", "899-89-9999"])
        return (r.choice(["phone", "mobile", "tel", "call", "fax", "SSN", "contact"]) + mark if r.random() < 0.6 else ""), _number_like(r, shape)
    if kind == "number":
        shape = r.choice(
            ["9999999999999999", "8999 8999 8999 8999", "1999-2012", "978-9-99-999999-9", "9.99999999", "10.9.99999.9999", "8 999 999.99", "899.89.89.89", "1999 - 2005", "89999999", "899999999999", "2019-12-89 12", "(1998) 89-899", "555-9999", "89.899.899"]
        )
        return (r.choice(["order", "ref", "invoice", "isbn", "item", "version", "page", "serial"]) + mark if r.random() < 0.5 else ""), _number_like(r, shape)
    if kind == "account":
        return (r.choice(["IBAN", "account", "bank account"]) + mark if r.random() < (0.6 if personal else 0.2) else r.choice(["", "serial ", "part "])), _account(r, personal)
    cues = ["born ", "born on ", "date of birth: ", "DOB: ", "birth date "] if personal else ["", "", "published ", "updated on ", "on ", "since ", "dated ", "version ", "order of "]
    return r.choice(cues), _day(r)


def examples(contexts: list[tuple[str, str]], each: int = EXAMPLES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of made candidates, `each` a judged kind and label, in the surroundings given."""
    r = random.Random(seed)
    x, y = [], []
    for kind in JUDGED:
        for personal in (True, False):
            for _ in range(each):
                before, after = r.choice(contexts) if contexts else ("", "")
                cue, value = _value(r, kind, personal)
                quote = '"' if cue.endswith('"') else "'" if cue.endswith("'") else ""
                head = before + cue
                x.append(features(head + value + quote + after, kind, len(head), len(head) + len(value)))
                y.append(float(personal))
    return np.array(x, float), np.array(y)


# ---- boosted trees ----------------------------------------------------------------------------


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: float = 1.0) -> dict:
    """Logistic gradient boosting with Newton leaves over at most 32 cuts a feature; trees as flat arrays."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T)])
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        tree = {"feature": [], "cut": [], "left": [], "right": [], "value": []}

        def grow(rows: np.ndarray, left: int) -> int:
            at = len(tree["value"])
            gs, hs = g[rows].sum(), h[rows].sum()
            for k, v in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("value", rate * gs / (hs + 1))):
                tree[k].append(float(v) if k in ("cut", "value") else v)
            best = (1e-6, -1, -1)
            if left and len(rows) > 1:
                for f in range(x.shape[1]):
                    m = len(cuts[f]) + 1
                    gl, hl = (np.cumsum(np.bincount(bins[rows, f], w[rows], m))[:-1] for w in (g, h))
                    ok = (hl >= least) & (hs - hl >= least)
                    gain = np.where(ok, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), -1)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
            if best[1] >= 0:
                f, b = best[1:]
                goes = bins[rows, f] <= b
                tree["feature"][at], tree["cut"][at] = f, float(cuts[f][b])
                tree["left"][at] = grow(rows[goes], left - 1)
                tree["right"][at] = grow(rows[~goes], left - 1)
            else:
                score[rows] += tree["value"][at]
            return at

        grow(np.arange(len(y)), depth)
        trees.append({k: np.array(v) for k, v in tree.items()})
    return {"base": base, "trees": trees}


def judge(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities for rows of features."""
    score = np.full(len(x), model["base"])
    for t in model["trees"]:
        at = np.zeros(len(x), int)
        while (inner := t["feature"][at] >= 0).any():
            goes = x[np.arange(len(x)), np.maximum(t["feature"][at], 0)] <= t["cut"][at]
            at = np.where(inner, np.where(goes, t["left"][at], t["right"][at]), at)
        score += t["value"][at]
    return 1 / (1 + np.exp(-score))


def contexts_of(docs: DataFrame, most: int = CONTEXTS) -> list[tuple[str, str]]:
    """Surroundings (40 characters before and 8 after a space) of one place in each of at most `most` documents."""
    found = docs.select(F.col("text").cast("string").alias("text")).filter("length(text) > 60").withColumn("h", F.xxhash64("text"))
    found = found.withColumn("at", F.expr("instr(substring(text, 41 + cast(pmod(h, length(text) - 50) as int)), ' ') + 41 + cast(pmod(h, length(text) - 50) as int)"))
    found = saved(found.select("h", F.expr("substring(text, at - 40, 40)").alias("b"), F.expr("substring(text, at - 1, 8)").alias("a")).distinct())
    return sorted((r["b"], r["a"]) for r in least_hashed(found, "h", most).select("b", "a").collect())


def train(docs: DataFrame, contexts: int = CONTEXTS, each: int = EXAMPLES) -> dict:
    """Trees and a threshold for each judged kind, from made examples in surroundings of at most `contexts` documents.

    Every fourth example is held out; a kind's threshold is the least at which the precision of what passes there
    is PRECISION (None, so that nothing is added, if no score reaches it), and `recall` is the share that passes.
    Without documents the examples stand alone.
    """
    prepare(docs.sparkSession)
    x, y = examples(contexts_of(docs, contexts), each)
    held = np.arange(len(y)) % 4 == 0
    model = boost(x[~held], y[~held])
    p, thresholds, recall = judge(model, x[held]), {}, {}
    for kind in JUDGED:
        mine = x[held][:, 0] == KINDS.index(kind)
        order = np.argsort(-p[mine], kind="stable")
        ranked, good = p[mine][order], np.cumsum(y[held][mine][order])
        last = np.append(ranked[1:] != ranked[:-1], True)[: len(ranked)]
        ok = np.flatnonzero((good / np.arange(1, len(ranked) + 1) >= PRECISION) & last & (ranked >= 0.5))
        thresholds[kind] = float(ranked[ok[-1]]) if len(ok) else None
        recall[kind] = float(good[ok[-1]] / good[-1]) if len(ok) else 0.0
    return model | {"thresholds": thresholds, "recall": recall}


def spans(text: str | None, model: dict | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each by start, then kind as listed."""
    found = proposals(text) if text else []
    order = lambda c: (c[1], KINDS.index(c[0]), c[2])
    base = sorted(((k, s, e) for k, s, e, ok in found if ok), key=order)
    more = [(k, s, e) for k, s, e, _ in found if k in JUDGED]
    added: list[tuple[str, int, int]] = []
    if model and more:
        scores = judge(model, np.array([features(text, *c) for c in more], float))
        limits = [model["thresholds"][k] for k, _, _ in more]
        passed = [(p, c) for p, t, c in zip(scores, limits, more) if t is not None and p >= t]
        for _, c in sorted(passed, key=lambda z: (-z[0], z[1][1], -z[1][2], z[1][0])):
            if not any(s <= c[1] and c[2] <= e for _, s, e in base) and not any(c[1] < e and s < c[2] for _, s, e in added):
                added.append(c)
    return base, sorted(base + added, key=order)


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row per input row: doc_id, counts of base spans by kind, base_sha256, spans, n_added.

    Null and empty texts have no spans. Repeated rows and null doc_ids are rows of their own; other columns are
    left out; no rows give no rows. Whole texts are searched, a batch of rows at a time, without a shuffle.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base, every = spans(text, model)
                n = Counter(k for k, _, _ in base)
                out.append((key, *(n[k] for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(freeing(run), FOUND)


def redact(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs, all columns and rows, with each span (overlapping ones as one) replaced by its first kind: `[email]`."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        merged: list[list] = []
        for k, s, e in spans(text, model)[1]:
            if merged and s < merged[-1][2]:
                merged[-1][2] = max(e, merged[-1][2])
            else:
                merged.append([k, s, e])
        out, done = [], 0
        for k, s, e in merged:
            out += [text[done:s], f"[{k}]"]
            done = e
        return "".join([*out, text[done:]]) if merged else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(freeing(run), docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_pii(docs, train(docs))
