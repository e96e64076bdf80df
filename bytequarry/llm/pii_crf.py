"""Operator 7: personal data. Patterns with checks give the base spans; a semi-Markov conditional random field adds
spans that the patterns miss (numbers without a country code, spelt-out addresses, addresses of version 6) and secrets
(keys and access tokens that are given a name).

The field looks at windows around digits, colons, spelt-out dots and long values behind a sign of assignment. A segment is a run of tokens, bounded in tokens
and characters; its score is the sum of weights of features of the whole span (its shape, the lengths of its digit
groups, its check digit, the words beside it). Dynamic programming over boundaries and kinds gives the best joint
choice and each segment's probability. Weights come from examples made by rule, by the gradient of the conditional
likelihood; no corpus rows are needed.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, quoted, spread, use_workers

KINDS = ("email", "ip", "card", "phone")
#: What the field tells apart.
FIELD_KINDS = (*KINDS, "secret")
ORDER = {k: i for i, k in enumerate(FIELD_KINDS)}

# Base patterns. The address before the sign is looked up from the sign; a number starts where its digits start.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    found, done = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                done = m.end()
                found.append((start, done, "email"))
    if DIGIT.search(text):
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = NOT_DIGIT.sub("", m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


# The field. Windows, tokens and candidate segments.
TRIGGER = re.compile(r"[0-9][0-9 ().:_/-]{6,}[0-9]|\b[Dd][Oo][Tt]\b|[(\[{<] ?[Aa][Tt] ?[)\]}>]|[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]+|[=:][ \"']{0,3}[A-Za-z0-9+/_-]{16,}")
TOKEN = re.compile(r"(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}=*|[0-9]+|[A-Za-z]+|\s+|.", re.DOTALL)
MARGIN, MAX_TOKENS, MAX_CHARS = 30, 24, 128
KEY = re.compile(r"[A-Za-z0-9+/_-]{16,}=*")
NAMED = re.compile(r"([A-Za-z]+)[\"']? ?(?:=|:|=>|:=) ?[\"'`]?$")
AT = re.compile(r" ?[(\[{<] ?at ?[)\]}>] ?| at ", re.IGNORECASE)
DOT = re.compile(r" ?[(\[{<] ?dot ?[)\]}>] ?| dot |\.", re.IGNORECASE)
SPELT = re.compile(r"[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+")
HEX = re.compile(r"[0-9a-f:]+")


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, merged where they meet."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@lru_cache(100_000)
def span_features(span: str) -> tuple[str, ...]:
    """Features of a whole span; empty if no kind could have it."""
    low = span.lower()
    digits = NOT_DIGIT.sub("", span)
    if KEY.fullmatch(span) and digits and len(digits) < len(span):
        bare = re.sub("[0-9+/=_-]", "", span)
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
        return ("key", f"length={min(len(span) // 8, 8)}", f"hex={not set(low) - set('0123456789abcdef')}", f"case={bare.islower()}{bare.isupper()}", f"marks={sum(c in '+/_-' for c in span) > 2}", f"turns={min(turns * 8 // len(span), 5)}", f"distinct={min(len(set(low)) // 3, 6)}")
    plain = DOT.sub(".", AT.sub("@", low, count=1))
    spelt = "@" in plain and "@" not in span and SPELT.fullmatch(plain)
    hexed = HEX.fullmatch(low) and low.count(":") >= 2
    if not spelt and not hexed and (len(digits) < 9 or len(digits) > 19 or re.search(r"[^0-9 ().+_/-]", span)):
        return ()
    out = [f"shape={re.sub('[a-z]+', 'a', re.sub('[0-9]+', '9', low))[:24]}"]
    if spelt:
        return (*out, "spelt", f"end={plain.rpartition('.')[2]}", f"labels={min(plain.count('.'), 4)}", f"brackets={any(c in low for c in '([{<')}")
    if hexed:
        groups = low.split(":")
        good = all(len(g) <= 4 for g in groups) and (len(groups) == 8 and "" not in groups or "::" in low and low.count("::") == 1 and len(groups) <= 8 and len([g for g in groups if g]) >= 2)
        return (*out, f"v6={good}", f"wide={any(len(g) > 2 for g in groups)}", f"groups={len(groups)}")
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    marks = "".join(sorted(set(NOT_DIGIT.sub(lambda m: m.group(), re.sub("[0-9]", "", span)))))
    return (*out, f"groups={'-'.join(map(str, groups))}", f"digits={len(digits)}", f"check={len(digits) >= 12 and luhn(digits)}", f"marks={marks}", f"lead={digits[0]}", f"open={span.count('(') == span.count(')')}")


def candidates(text: str) -> tuple[int, list[tuple[int, int, int, int, tuple[str, ...]]]]:
    """(number of tokens, [(first token, token after the last, start, end, features)]) of a window."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    out = []
    for i, (start, first_end) in enumerate(tokens):
        if not (text[start].isalnum() or text[start] in "+(:"):
            continue
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            end = tokens[j][1]
            if end - start > MAX_CHARS:
                break
            if text[end - 1].isalnum() and end - start >= 7 and (own := span_features(text[start:end])):
                left = re.search(r"([A-Za-z]+)[:.]? ?$", text[max(0, start - 12) : start])
                beside = (f"left={left.group(1).lower() if left else text[start - 1 : start]}", f"after={'a' if text[end : end + 1].isalnum() else text[end : end + 1]}", f"before={'a' if start and text[start - 1].isalnum() else text[start - 1 : start] if start else ''}")
                if own[0] == "key":
                    name = NAMED.search(text[max(0, start - 24) : start])
                    name = name.group(1).lower() if name else ""
                    out.append((i, j + 1, start, end, (*own, f"name={name}", f"named={name != ''}", *(f"name={name},{x}" for x in own[1:4]), *beside, "any")))
                    continue
                longer = f"cut={bool(re.match(r'[ .()_/-]?[0-9(:]', text[end : end + 2])) or bool(re.search(r'[0-9)][ .(_/:-]?$', text[max(0, start - 2) : start]))}"
                out.append((i, j + 1, start, end, (*own, *beside, longer, "any")))
    return len(tokens), out


class Field:
    """Weights by (kind, feature)."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = {} if weights is None else weights

    def scores(self, segments) -> list[list[float]]:
        w = self.weights
        return [[sum(w.get((k, f), 0.0) for f in s[4]) for k in FIELD_KINDS] for s in segments]

    def marginals(self, n: int, segments, scores) -> list[list[float]]:
        """Probability of each segment and kind, by sums over all segmentations of n tokens."""
        into, outof = defaultdict(list), defaultdict(list)
        for s, (i, j, *_) in enumerate(segments):
            total = _log_sum(scores[s])
            into[j].append((i, total))
            outof[i].append((j, total))
        front, back = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            front[j] = _log_sum([front[j - 1], *(front[i] + x for i, x in into[j])])
        for i in range(n - 1, -1, -1):
            back[i] = _log_sum([back[i + 1], *(back[j] + x for j, x in outof[i])])
        return [[math.exp(min(0.0, front[s[0]] + x + back[s[1]] - front[n])) for x in row] for s, row in zip(segments, scores, strict=True)]

    def best(self, n: int, segments, scores) -> list[tuple[int, int]]:
        """(segment, kind) of the best segmentation."""
        into = defaultdict(list)
        for s, (i, j, *_) in enumerate(segments):
            k = max(range(len(FIELD_KINDS)), key=scores[s].__getitem__)
            into[j].append((scores[s][k], i, s, k))
        value, took = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for x, i, s, k in into[j]:
                if value[i] + x > value[j]:
                    value[j], took[j] = value[i] + x, (i, s, k)
        out, j = [], n
        while j:
            if took[j]:
                j, s, k = took[j]
                out.append((s, k))
            else:
                j -= 1
        return out[::-1]

    def spans(self, text: str, least: float) -> list[Span]:
        """Spans of the best segmentation whose probability is at least `least`."""
        found = []
        for a, b in windows(text):
            n, segments = candidates(text[a:b])
            if segments:
                scores = self.scores(segments)
                chosen = self.best(n, segments, scores)
                if chosen:
                    p = self.marginals(n, segments, scores)
                    found += [(a + segments[s][2], a + segments[s][3], FIELD_KINDS[k]) for s, k in chosen if p[s][k] >= least]
        return found


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Texts made by rule, with their spans: written forms of each kind, and look-alikes that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghiklmnoprstuvw", k=r.randint(2, 9)))
    digits = lambda k: "".join(r.choices("0123456789", k=k))

    def card():
        d = r.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice("._").join(d[i : i + 4] for i in range(0, 16, 4))

    def phone():
        a, b, c = r.choice("23456789") + digits(2), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"00{r.randint(1, 9)}{digits(1)} {digits(2)} {digits(4)} {digits(4)}", f"({a}) {b} {c}"])

    def email():
        at, dot = r.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" at ", " dot ")])
        host = dot.join([*(word() for _ in range(r.randint(1, 2))), r.choice(["com", "org", "net", "de", "fr", "es", "info"])])
        return word() + r.choice(["", ".", "_"]) + r.choice([word(), digits(2)]) + at + host

    def ip():
        h = lambda: "".join(r.choices("0123456789abcdef", k=r.randint(1, 4)))
        return r.choice([":".join("".join(r.choices("0123456789abcdef", k=4)) for _ in range(8)), f"2001:db8::{h()}", f"fe80::{h()}:{h()}:{h()}", f"2a02:{h()}:{h()}::{h()}"])

    hexed = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    mixed = lambda k: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", k=k))

    def secret():
        return r.choice([hexed(r.choice([32, 40, 48, 64])), mixed(r.randint(20, 60)), r.choice(["ab", "sk", "key", "tok"]) + "_" + mixed(r.randint(24, 40)), hexed(40).upper()])

    def assigned(name):
        q = r.choice(['"', '"', "'", ""])
        return r.choice([name, name.upper(), name.capitalize()]) + r.choice([" = ", "=", ": "]) + q, q

    def public():
        """Long values that are no secrets: checksums, revisions, ids, names."""
        h = hexed(32)
        value = r.choice([hexed(40), hexed(64), h, f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", f"{word()}_{word()}_{word()}_{digits(2)}", f"{word()}-{word()}-{word()}-{digits(4)}", f"{word()}/{word()}/{word()}{digits(2)}"])
        name = r.choice(["commit", "sha", "hash", "checksum", "revision", "id", "uuid", "file", "version", "etag", "md", "class", "name", "path"])
        lead, q = assigned(name)
        return r.choice([lead + value + q, f"{name} {value}", value])

    def none():
        if r.random() < 0.25:
            return public()
        y, m, d = r.randint(1900, 2099), r.randint(1, 12), r.randint(1, 28)
        bad = digits(15)
        bad += next(c for c in "0123456789" if not luhn(bad + c))
        return r.choice([
            f"{y}-{m:02d}-{d:02d}", f"{y}-{m:02d}-{d:02d} {r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", digits(r.randint(8, 11)), bad, digits(20), f"978-3-{digits(2)}-{digits(6)}-{digits(1)}",
            f"{y}-{r.randint(2000, 2100)} {r.randint(1, 400)}-{r.randint(1, 400)}", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}", f"{digits(1)}.{digits(9)}", f"{digits(2)}.{digits(2)}.{y} {digits(5)}", f"{word()} at the dot of {word()}", f"a dot {word()}", f"{digits(4)} {digits(5)} {digits(4)}", f"{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
            "-".join(digits(r.randint(1, 6)) for _ in range(r.randint(3, 6))), " ".join(digits(r.randint(1, 4)) for _ in range(r.randint(4, 7))), ":".join(digits(2) for _ in range(r.randint(3, 6))), f"{bad[:4]}.{bad[4:8]}.{bad[8:12]}.{bad[12:]}",
        ])

    hints = {"phone": ["tel", "phone", "call", "fax"], "card": ["card", "visa"], "email": ["mail", "contact", "write"], "ip": ["host", "from", "address"], "": ["on", "id", "no", "number", "order"]}
    made = {"phone": phone, "card": card, "email": email, "ip": ip, "secret": secret, "": none}
    names = ["token", "key", "secret", "password", "apikey", "auth", "passwd", "credential"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 2)):
            kind = r.choice(["", "", "", *FIELD_KINDS])
            text += " ".join(word() for _ in range(r.randint(2, 5))) + r.choice([" ", ". ", ", ", "\n"])
            close = ""
            if kind == "secret":
                lead, close = assigned(r.choice(names))
                text += r.choice(["", "api_", "access_"]) + lead
            elif r.random() < 0.4:
                text += r.choice(hints[kind]) + r.choice([" ", ": "])
            value = made[kind]()
            if kind:
                spans.append((len(text), len(text) + len(value), kind))
            text += value + close + r.choice([" ", ". ", ", ", "\n"])
        out.append((text + word(), spans))
    return out


@lru_cache(2)
def trained(n: int = 1400, seed: int = 7, rounds: int = 8, rate: float = 0.7, shrink: float = 0.002) -> Field:
    """Weights that raise the conditional likelihood of the examples' spans (gradient steps, shrunk towards zero)."""
    field, made = Field(defaultdict(float)), []
    for text, spans in examples(n, seed):
        for a, b in windows(text):
            tokens, segments = candidates(text[a:b])
            gold = {(x - a, y - a, k) for x, y, k in spans}
            if segments:
                made.append((tokens, segments, [[float((s[2], s[3], k) in gold) for k in FIELD_KINDS] for s in segments]))
    for turn in range(rounds):
        random.Random(seed + turn).shuffle(made)
        step = rate / (1 + turn)
        for tokens, segments, gold in made:
            p = field.marginals(tokens, segments, field.scores(segments))
            for s, want, have in zip(segments, gold, p, strict=True):
                for k, x, y in zip(FIELD_KINDS, want, have, strict=True):
                    if abs(x - y) > 1e-3:
                        for f in s[4]:
                            field.weights[k, f] += step * (x - y) / 3
        for key in field.weights:
            field.weights[key] *= 1 - shrink
    return Field({k: v for k, v in field.weights.items() if abs(v) > 1e-4})


def all_spans(text: str, field: Field, least: float) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and those of the field that overlap none of them), in order."""
    base = base_spans(text)
    added = field.spans(text, least)
    added = [s for s in added if all(s[1] <= b[0] or b[1] <= s[0] for b in base)]
    return base, sorted(base + added, key=lambda s: (s[0], ORDER[s[2]])) if added else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in capitals in angle brackets."""
    out, done = [], 0
    for a, b, k in spans:
        if a >= done:
            out += [text[done:a], f"<{k.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def marked(docs: DataFrame, text: str = "text", least: float = 0.9) -> DataFrame:
    """(row, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted) for each row; row holds all its columns.

    Counts and the hash are of base spans; spans lists all, `kind:start:end` (a kind of the field's own is `secret`) in code points, by start and kind;
    redacted is the text with all of them replaced (null stays null). least: probability from which the field's spans
    are taken. Null text counts as empty; repeated rows give repeated results; an empty table an empty result.
    """
    spark = docs.sparkSession
    use_workers(spark)
    weights = spark.sparkContext.broadcast(trained().weights)
    rows = spread(docs.select(F.struct(*map(quoted, docs.columns)).alias("row")))
    counts, texts = [f"n_{k}" for k in KINDS], ["base_sha256", "spans", "redacted"]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in counts), *(T.StructField(c, T.StringType()) for c in texts)])

    def find(batches):
        field = kept("Field", id(weights.value), make=lambda: Field(weights.value))
        for batch in batches:
            out = {k: [] for k in (*counts, *texts)}
            for x in batch.column("row").field(text).to_pylist():
                base, spans = all_spans(x or "", field, least)
                kinds = [s[2] for s in base]
                for k in KINDS:
                    out[f"n_{k}"].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(spans))
                out["redacted"].append(redact(x, spans) if spans else x)
            kinds = [pa.int64()] * len(counts) + [pa.string()] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["row", *out])

    return rows.mapInArrow(find, schema)


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = 0.9) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted) for each row, as marked() has it."""
    made = marked(docs.select(quoted(doc_id), quoted(text)), text, least)
    return made.select(F.col("row")[doc_id].cast("long").alias("doc_id"), *made.columns[1:])
