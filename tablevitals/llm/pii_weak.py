"""Personal data by weak supervision.

Fixed patterns give the base spans. Wider candidates are voted on by regular
expression, gazetteer and context labelers; expectation-maximisation estimates
from all candidates of the corpus how reliable each labeler is, and a logistic
classifier over the shape and surroundings of a span learns from the resulting
probabilities. Spans it accepts are added to the base spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import carries_its_code, fresh, map_column, written

carries_its_code(__name__)

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "number", "address")

# Possessive forms of the base patterns: the same matches, found in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
WRITTEN_AT = ("at)", "at]", "at )", "at ]")

# Wider candidates.
SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{12,}+")
NUMBER = re.compile(r"(?<![0-9])[0-9](?:[ ().-]{0,2}[0-9]){6,}+")
ADDRESS = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[A-Za-z0-9-]++)++"
)
SEPARATED = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{2,5}[ /-][0-9]{5,9}")
HEXADECIMAL = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
# Words before a value that name it, in the languages of the corpus.
GAZETTEER = {
    "secret": {"password", "passwd", "pwd", "token", "secret", "key", "apikey", "api_key", "auth", "bearer", "passwort",
               "kennwort", "mot de passe", "contraseña", "clave"},
    "number": {"phone", "tel", "telephone", "mobile", "call", "fax", "ssn", "social", "passport", "iban", "account",
               "telefon", "handy", "konto", "téléphone", "compte", "teléfono", "cuenta", "móvil"},
    "address": {"mail", "email", "e-mail", "contact", "correo", "courriel", "kontakt"},
}
# Beginnings that issuers give their keys.
KEY_BEGINNINGS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-")
LAST_WORD = re.compile(r"([^\W\d]+(?:[_-][^\W\d]+)*)\W*$")
CONTEXT_CHARS = 40
# Votes and features are single digits, so their combinations are few whatever the size of the corpus.
LABELERS = 4
# How votes against, abstaining and for fall on true spans before any are seen; on others the other way round.
RIGHT = np.array([0.1, 0.4, 0.5])


@dataclass
class SpanModel:
    """Probability of personal data for each combination of kind, votes and features; reliabilities for inspection."""

    probability: dict[str, float]
    hit_rate: np.ndarray  # P(vote | span is personal data) per labeler and vote (-, 0, +)
    false_rate: np.ndarray
    prior: float


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Email, ip, card and phone spans (code points, end exclusive), leftmost and without overlap for each kind."""
    spans = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        free = at + 1
        if begin < at and (domain := DOMAIN.match(text, at + 1)):
            free = domain.end()
            spans.append(("email", begin, free))
        at = text.find("@", free)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            spans.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


def votes_and_features(text: str, kind: str, begin: int, end: int) -> str:
    """Kind, votes (0 against, 1 abstains, 2 for) of the labelers, and bucketed features, as one code."""
    span = text[begin:end]
    before = text[max(0, begin - CONTEXT_CHARS) : begin]
    digits = sum("0" <= c <= "9" for c in span)
    letters = sum(c.isalpha() for c in span)
    named = LAST_WORD.search(before)
    cue = named.group(1).lower() if named else ""
    group = {"email": "address", "phone": "number", "card": "number", "ip": "number"}.get(kind, kind)
    assigned = bool(re.search(r"[=:]\s*[\"']?$", before))
    quoted = before[-1:] in "\"'" and text[end : end + 1] == before[-1:] if before else False
    # Regular expression labeler: a strict form of the kind.
    if kind in BASE_KINDS:
        strict = 2
    elif kind == "secret":
        strict = 2 if HEXADECIMAL.fullmatch(span) or span.startswith(KEY_BEGINNINGS) else 1
    elif kind == "number":
        strict = 2 if SEPARATED.fullmatch(span) else (0 if len(span) == digits else 1)
    else:
        strict = 2
    # Gazetteer labeler: the word before names the value.
    issued = kind == "secret" and span.startswith(KEY_BEGINNINGS)
    known = 2 if issued or cue in GAZETTEER[group] else 1
    # Context labeler: an assignment, or a place in running prose that speaks against it.
    if assigned or quoted:
        context = 2
    elif kind in ("secret", "number") and not issued:
        context = 0
    else:
        context = 1
    # Surprise labeler: letters and digits change often in made-up strings, rarely in words.
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
    if kind == "secret":
        surprise = 2 if turns * 6 >= len(span) else (1 if issued else 0)
    else:
        surprise = 1
    size = min(3, (end - begin) // 10)
    share = min(3, 4 * digits // max(1, end - begin))
    return f"{KINDS.index(kind)}{strict}{known}{context}{surprise}{size}{share}{int(assigned)}{int(quoted)}"


def all_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Base spans and candidates, each with its code; candidates don't overlap base spans or one another."""
    if not text or not (SIGN.search(text) or any(a in text for a in WRITTEN_AT)):
        return []
    result = base_spans(text)
    taken = [(b, e) for _, b, e in result]
    if "at" in text:
        result += [("address", m.start(), m.end()) for m in ADDRESS.finditer(text)]
    for m in SECRET.finditer(text):
        if any(c.isdigit() for c in m.group()) and any(c.isalpha() for c in m.group()):
            result.append(("secret", m.start(), m.end()))
    for m in NUMBER.finditer(text):
        if sum(c.isdigit() for c in m.group()) <= 19:
            result.append(("number", m.start(), m.end()))
    base = len(taken)
    taken.sort()
    kept = result[:base]
    covered = np.zeros(0)
    if len(result) > base:
        starts, ends = (np.array([s[i] for s in taken]) for i in (0, 1)) if taken else (covered, covered)
        ends = np.maximum.accumulate(ends) if len(ends) else ends
        last = -1
        for kind, b, e in sorted(result[base:], key=lambda s: (s[1], -s[2])):
            i = int(np.searchsorted(starts, e))
            if b >= last and not (i and ends[i - 1] > b):
                kept.append((kind, b, e))
                last = e
    return [(kind, b, e, votes_and_features(text, kind, b, e)) for kind, b, e in kept]


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, rounds: int = 50):
    """Class probabilities per row of ``votes`` (0, 1, 2 for each labeler), and vote rates of both classes.

    Labelers are taken as independent given the class. The start is the share
    of votes in favour. Pseudo-counts that say a labeler is right more often
    than wrong, a quarter of the spans in weight, keep the classes from
    trading places and hold where a corpus has spans of one class only.
    """
    if not len(votes):
        flat = np.full((LABELERS, 3), 1 / 3)
        return np.zeros(0), flat, flat, 0.5
    in_favour = (votes - 1).sum(axis=1)
    p = 1 / (1 + np.exp(-1.5 * in_favour))
    hit = false = np.zeros((votes.shape[1], 3))
    prior = 0.5
    belief = max(3.0, count.sum() / 4)
    for _ in range(rounds):
        rates = []
        for weight in (p * count, (1 - p) * count):
            table = np.stack([np.bincount(votes[:, j], weight, 3) for j in range(votes.shape[1])])
            table = table + belief * (RIGHT if not rates else RIGHT[::-1])
            rates.append(table / table.sum(axis=1, keepdims=True))
        hit, false = rates
        prior = float(np.clip((p * count).sum() / count.sum(), 0.01, 0.99))
        places = np.arange(votes.shape[1])
        odds = np.log(hit[places, votes] / false[places, votes]).sum(axis=1) + np.log(prior / (1 - prior))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, hit, false, prior


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model fitted to soft targets by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = weight * p * (1 - p)
        step = np.linalg.solve((x * curve[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (weight * (target - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def one_hot(codes: np.ndarray) -> np.ndarray:
    """Indicators of every digit of the codes, and a constant."""
    return np.column_stack([np.ones(len(codes)), *[(codes[:, j] == v) for j in range(codes.shape[1]) for v in range(len(KINDS))]])


def train_spans(codes: list[str], counts: list[int]) -> SpanModel:
    """Reliabilities by expectation-maximisation, then the classifier over kind, votes and features.

    Base spans need no verdict and take no part.
    """
    chosen = [i for i, code in enumerate(codes) if int(code[0]) >= len(BASE_KINDS)]
    codes, counts = [codes[i] for i in chosen], [counts[i] for i in chosen]
    count = np.array(counts, dtype=float)
    if not codes:
        _, hit, false, prior = expectation_maximisation(np.zeros((0, LABELERS), np.int64), count)
        return SpanModel({}, hit, false, prior)
    digits = np.array([[int(c) for c in code] for code in codes], dtype=np.int64)
    p, hit, false, prior = expectation_maximisation(digits[:, 1 : 1 + LABELERS], count)
    x = one_hot(digits)
    # Damped weights: a combination seen a million times is not a million times as telling.
    fitted = x @ logistic(x, p, np.sqrt(count))
    return SpanModel(dict(zip(codes, (1 / (1 + np.exp(-fitted))).tolist())), hit, false, prior)


SPANS = "array<struct<kind:string,begin:int,end:int,code:string>>"


def with_candidates(df: DataFrame, text: str, spans: str) -> DataFrame:
    def start() -> Callable[[list], list]:
        return lambda texts: [
            [[dict(kind=k, begin=b, end=e, code=c) for k, b, e, c in all_spans(t or "")] for t in texts]
        ]

    return map_column(df, text, f"`{spans}` {SPANS}", start)


def learn(found: DataFrame, spans: str) -> SpanModel:
    """The model from all spans of ``found``; the driver sees one row per combination of single-digit values."""
    codes = found.select(F.explode(spans).alias("s")).groupBy("s.code").count().orderBy("code").collect()
    return train_spans([r[0] for r in codes], [r[1] for r in codes])


def accepted(spans: list[dict], model: SpanModel, least: float) -> list[tuple[str, int, int]]:
    """Base spans and the accepted others, by kind as listed and then by place."""
    chosen = [s for s in spans if s["kind"] in BASE_KINDS or model.probability.get(s["code"], 0.0) >= least]
    return sorted(((s["kind"], s["begin"], s["end"]) for s in chosen), key=lambda s: (KINDS.index(s[0]), s[1]))


def find_personal_data(df: DataFrame, text: str = "text", least: float = 0.8) -> DataFrame:
    """``df`` without its text, with ``found``: an array of (kind, begin, end) in each whole text.

    Base spans are always in it; others if their probability is at least
    ``least``. Votes are gathered from all rows. Null counts as empty: no spans.
    Repeated rows give repeated rows, an empty table none; a column called
    ``found`` is replaced.
    """
    df = df.drop("found") if text != "found" else df
    (spans,) = fresh(df, "candidate_spans")
    candidates = written(with_candidates(df, text, spans).drop(text))
    model = learn(candidates, spans)

    def start() -> Callable[[list], list]:
        return lambda rows: [
            [[dict(kind=k, begin=b, end=e) for k, b, e in accepted(row, model, least)] for row in rows]
        ]

    return map_column(candidates, spans, "found array<struct<kind:string,begin:int,end:int>>", start).drop(spans)


def digests(df: DataFrame) -> DataFrame:
    """Counts and digests of ``found``: base counts, a SHA-256 of the base spans, and all spans as text.

    Rows without spans have zeros, the hash of nothing and an empty text.
    Repeated rows give repeated rows, an empty table none; columns with the new
    names are replaced.
    """

    def joined(spans: list[dict]) -> str:
        return ",".join([f"{s['kind']}:{s['begin']}:{s['end']}" for s in spans])

    def compute(rows: list) -> list:
        base = [[s for s in row if s["kind"] in BASE_KINDS] for row in rows]
        counts = [[sum(s["kind"] == k for s in row) for row in base] for k in BASE_KINDS]
        hashes = [hashlib.sha256(joined(row).encode()).hexdigest() for row in base]
        return [*counts, hashes, [joined(row) for row in rows]]

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_column(df, "found", schema, lambda: compute).drop("found")


def redact(df: DataFrame, text: str = "text", least: float = 0.8) -> DataFrame:
    """``df`` with every span replaced by its kind in angle brackets; other texts, nulls and columns stay as they are.

    Overlapping spans become one mark, of the kind that begins first. The model
    comes from one pass that keeps counts only; texts are rewritten in a second.
    Empty texts stay empty. Repeated rows give repeated rows, an empty table
    none; columns may have any names.
    """
    (spans,) = fresh(df, "candidate_spans")
    found = with_candidates(df.select(text), text, spans).select(spans)
    model = learn(found, spans)

    def rewritten(value: str) -> str:
        chosen = accepted([dict(kind=k, begin=b, end=e, code=c) for k, b, e, c in all_spans(value)], model, least)
        parts, at = [], 0
        for kind, begin, end in sorted(chosen, key=lambda s: (s[1], -s[2])):
            if begin >= at:
                parts += [value[at:begin], f"<{kind.upper()}>"]
            at = max(at, end)
        return "".join(parts) + value[at:] if parts else value

    (read,) = fresh(df, "text_read")

    def start() -> Callable[[list], list]:
        return lambda texts: [[None if t is None else rewritten(t) for t in texts]]

    masked = map_column(df.withColumnRenamed(text, read), read, f"`{text}` string", start)
    return masked.select(*df.columns)
