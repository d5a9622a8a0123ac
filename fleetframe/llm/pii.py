"""Personal data: rules, and a tagger that adds what the rules miss.

The rules give the base spans.  The tagger (``tagger.py``) reads the text
around digits and at signs, without which no span of these kinds exists, in
overlapping windows; where windows overlap, each character takes its tag
from the window in whose middle it stands most, and spans are built from the
tags of the whole text.  An added span must overlap no base span and pass a
check of its kind.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import append_columns, col, without
from fleetframe.llm.tagger import KINDS, Tagger, classes, spans_of, train

Span = tuple[str, int, int]

# The rules of the base spans.  A match cannot begin within a
# run of digits unless one fails at its start, so (?<![0-9]) changes nothing
# but spares a run from being read again from each of its digits.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

WINDOW, STRIDE, CONTEXT = 96, 48, 24
BATCH = 256  # windows decoded at once
EXAMPLES = 1500  # labelled texts the tagger learns from


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return (sum(map(int, digits[-1::-2])) + sum(twice[int(d)] for d in digits[-2::-2])) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each at sign back over the local part, which
    reaches no further than the last match, and on over the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The spans of the rules, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m.group().split(".") if len(p.lstrip("0")) <= 3) and all(
                len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = digits_of(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def plausible(kind: str, s: str) -> bool:
    """The check of an added span."""
    d = digits_of(s)
    if kind == "email":
        return re.fullmatch(r"[\w.%+'-]+ ?@ ?[\w-]+(?:\.[\w-]+)+", s) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return (re.fullmatch(r"(?:00[1-9][0-9]{0,2}|\([0-9]{2,5}\)|0[0-9]{2,4}|[0-9]{3})[ ./()-]+[0-9][0-9 ./()-]{4,}[0-9]", s) is not None
            and 9 <= len(d) <= 15)


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Labelled texts: personal data in many forms, and look-alikes (years,
    prices, versions, dates, codes) that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "the", "on", "ch", "que", "ing", "é", "st", "or", "li", "ou")) for _ in range(r.randint(1, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + num(r.choice((11, 13, 14, 14, 14, 15)))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(s: str) -> str:
        sep = r.choice(("", " ", "-", "."))
        return sep.join(s[i:i + 4] for i in range(0, len(s), 4))

    def email() -> str:
        user = word() + r.choice(("", ".", "_", "+")) + r.choice((word(), num(2)))
        host = word() + r.choice((".com", ".org", ".net", ".de", ".co.uk", ".example.com"))
        return r.choice((user + "@" + host,) * 4 + (user + " @ " + host,))

    def phone() -> str:
        return r.choice((f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"+{r.randint(1, 99)} {num(3)} {num(7)}",
                         f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{r.randint(1, 99)} {num(3)} {num(7)}",
                         f"0{num(3)}/{num(7)}", f"+{r.randint(1, 99)}.{num(3)}.{num(3)}.{num(4)}"))

    def ip() -> str:
        return r.choice((".", ".", ".", " . ")).join(str(r.randint(0, 255)) for _ in range(4))

    makers = {"email": email, "ip": ip, "card": lambda: grouped(card()), "phone": phone}
    decoys = (lambda: str(r.randint(1200, 2100)), lambda: f"${num(2)}.{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}",
              lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{num(2)}:{num(2)}:{num(2)}",
              lambda: num(r.randint(1, 11)), lambda: "#" + num(5), lambda: word() + "@", lambda: "@" + word(),
              lambda: f"{num(3)},{num(3)}", lambda: f"{num(1)}.{num(2)}", lambda: word() + num(3) + word(),
              lambda: f"{num(3)}-{num(2)}", lambda: f"AKIA{num(8)}{word().upper()}", lambda: f"{r.randint(256, 999)}.{num(3)}.{num(2)}.{num(1)}")
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 5))), []
        for _ in range(r.randint(1, 2)):
            text += r.choice((" ", " ", ": ", ", ", "\n", " (")) if text else ""
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                s = makers[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += r.choice(decoys)()
            text += r.choice((" ", ". ", ", ", ") ", "\n")) + " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def trained(n: int = EXAMPLES, seed: int = 11) -> Tagger:
    return train(examples(n, seed), hidden=20, batch=32, rate=0.02)


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over the text around digits and at signs."""
    out, regions = [], []
    for m in re.finditer(r"[0-9@]+", text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    for a, b in regions:
        while b - a > WINDOW:
            out.append((a, a + WINDOW))
            a += STRIDE
        out.append((a, b))
    return out


def reconciled(length_of: Sequence[tuple[int, int]], tags: Sequence[np.ndarray]) -> list[Span]:
    """Spans of one text from its windows' tags.  Windows come in order; a
    character in two takes the tag of that whose middle is nearer."""
    out: list[Span] = []
    at = 0
    while at < len(length_of):
        end = at + 1  # windows that overlap in a row
        while end < len(length_of) and length_of[end][0] < length_of[end - 1][1]:
            end += 1
        first, last = length_of[at][0], length_of[end - 1][1]
        whole, dist = np.zeros(last - first, np.int64), np.full(last - first, np.inf)
        for (a, b), t in zip(length_of[at:end], tags[at:end]):
            d = np.abs(np.arange(a, b) + 0.5 - (a + b) / 2)
            near = d < dist[a - first:b - first]
            whole[a - first:b - first][near] = t[near]
            dist[a - first:b - first][near] = d[near]
        out += [(k, first + s, first + e) for k, s, e in spans_of(whole)]
        at = end
    return out


def tag(tagger: Tagger, texts: Sequence[str]) -> list[list[Span]]:
    """The tagger's spans of each text."""
    at = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(t)]
    tags: list[np.ndarray] = [np.zeros(0, np.int64)] * len(at)
    order = sorted(range(len(at)), key=lambda k: at[k][2] - at[k][1])
    for a in range(0, len(order), BATCH):
        group = order[a:a + BATCH]
        parts = [classes(texts[at[k][0]][at[k][1]:at[k][2]]) for k in group]
        x = np.zeros((max(map(len, parts)), len(parts)), np.int64)
        for j, p in enumerate(parts):
            x[:len(p), j] = p
        found = tagger.decode(x)
        for j, k in enumerate(group):
            tags[k] = found[:len(parts[j]), j]
    out: list[list[Span]] = [[] for _ in texts]
    by_text: dict[int, list[int]] = {}
    for k, (i, _, _) in enumerate(at):
        by_text.setdefault(i, []).append(k)
    for i, ks in by_text.items():
        out[i] = reconciled([at[k][1:] for k in ks], [tags[k] for k in ks])
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without white space and punctuation at its ends."""
    while a < b and text[a] in " \t\r\n.,;:)!?":
        a += 1
    while b > a and text[b - 1] in " \t\r\n.,;:(!?":
        b -= 1
    return a, b


def all_spans(tagger: Tagger, texts: Sequence[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each text, by kind, then start."""
    out = []
    for text, more in zip(texts, tag(tagger, texts)):
        base = base_spans(text)
        extra: list[Span] = []
        for kind, a, b in more:
            a, b = trimmed(text, a, b)
            if a < b and plausible(kind, text[a:b]) and all(b <= x or y <= a for _, x, y in (*base, *extra)):
                # A number that goes on to either side is something else.
                if not (text[a - 1:a].isalnum() or text[b:b + 1].isalnum()):
                    extra.append((kind, a, b))
        out.append((base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: Sequence[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of spans
    that overlap, the whole stretch by the kind that begins first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType())]))


def find(docs: DataFrame, text: str = "text", out_text: bool = False) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans`` (kind, start, end in
    code points), and with ``out_text`` also ``masked`` texts.

    Null and empty texts have no spans; a null text stays null.  Repeated
    rows are read each; output columns replace input columns of their names.
    """
    tagger = trained()
    fields = [T.StructField("base_spans", SPAN), T.StructField("all_spans", SPAN)]
    fields += [T.StructField("masked", T.StringType())] * out_text
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def compute(column: pa.Array) -> list[pa.Array]:
            raw = column.to_pylist()
            found = all_spans(tagger, [t or "" for t in raw])
            rows = lambda k: pa.array([[{"kind": s[0], "start": s[1], "end": s[2]} for s in f[k]] for f in found], kind)
            arrays = [rows(0), rows(1)]
            if out_text:
                arrays.append(pa.array([t if t is None else masked(t, f[1]) for t, f in zip(raw, found)], pa.string()))
            return arrays
        return compute

    return append_columns(docs, text, fields, make)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text`` replaced by their kinds, and
    ``n_chars`` (where there is one) counted anew."""
    columns = docs.columns
    work = find(docs.select(*[col(c).alias(f"_ff_in_{i}") for i, c in enumerate(columns)]),
                f"_ff_in_{columns.index(text)}", out_text=True)
    new = {text: F.col("masked"), "n_chars": F.coalesce(F.length("masked").cast("bigint"), F.lit(0).cast("bigint"))}
    return work.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"_ff_in_{i}")).alias(c)
                         for i, c in enumerate(columns)])


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the number of base spans of each kind, the SHA-256 of the
    joined base spans, and all spans joined.

    Null and empty texts have no spans (the digest is that of the empty
    string).  Null and repeated keys keep their rows; texts of any length are
    read whole, in overlapping windows; of equal starts a span of an earlier
    kind is named first.  Columns other than key and text are not read, and an
    empty table gives no rows.
    """
    found = find(without(docs.select(col(key).alias("_ff_key"), col(text).alias("_ff_text"))), "_ff_text")
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        F.col("_ff_key").alias(key), *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(said("base_spans"), 256).alias("base_sha256"), said("all_spans").alias("spans"))
