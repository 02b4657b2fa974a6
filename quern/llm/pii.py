"""Personal data: patterns propose spans, check digits confirm them, context words move their score.

Base kinds, always kept when their rule holds: email, ip (parts at most 255), card (16 to 19 digits that pass Luhn) and
phone (+ and 8 to 15 digits); each leftmost and without overlap within its kind, a failing match is dropped.
Added kinds, kept at a score of MIN_SCORE: iban (mod-97 of the whole number, whose length is that of its country; for a
country that the registry doesn't hold the longest run of whole groups that passes, and only near a context word), account (13 to 15
digits), tel (7 to 12 digits without a plus) and secret (an unbroken run of at least 20 letters, digits and + / _ - = that holds both;
the variety of its characters is what is checked). A pattern starts at its kind's score, a passed check adds, a context word
within NEAR characters adds. An added span never overlaps a base one, nor an added one of a kind listed before.

Time is linear in the text, but for a logarithm of the number of spans. Defined cases: null text is empty and has no spans; every row is scanned
whole and by itself, so repeated rows and null doc_ids give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .support import released, slices, whole_text

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "account", "tel", "secret")
NEAR, MIN_SCORE = 40, 0.6

# Context words by kind, and the length of an IBAN by country.
CONTEXT = {
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "transfer"),
    "account": ("card", "credit", "visa", "amex", "karte", "carte", "tarjeta"),
    "tel": ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono", "handy"),
    "secret": ("token", "secret", "password", "passwd", "passwort", "contraseña", "key", "apikey", "api", "auth", "bearer", "credential", "credentials"),
}
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30".split()}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
#: Bits a character that the characters of a secret carry at least; words and repeated patterns carry less.
VARIETY = 3.0
TEL = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,5}\)?[ /-][0-9][0-9 -]{4,12}[0-9](?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod_97(number: str) -> bool:
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def varied(run: str) -> bool:
    """Letters and digits, of many kinds."""
    counts = Counter(run)
    return any("0" <= c <= "9" for c in counts) and any(c.isalpha() for c in counts) and -sum(k * math.log2(k / len(run)) for k in counts.values()) >= VARIETY * len(run)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the run of local characters before it: a local part can't reach over an @ or into the last match."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end()
        free = end.end() if end else at + 1
        at = max(at + 1, free)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.groups())]
    cards = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            cards.append(("card", *m.span()))
    out += cards
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _near(text: str, start: int, end: int, kind: str) -> bool:
    around = set(re.findall(r"[^\W\d_]+", (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()))
    return any(w in around for w in CONTEXT[kind])


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The places that spans cover, in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def added_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    out, held = [], [_merged(taken), *([] for _ in ADDED)]  # of each kind the places in order, without overlap

    def is_free(spans: list[tuple[int, int]], start: int, end: int) -> bool:
        k = bisect_left(spans, (end,))
        return not k or spans[k - 1][1] <= start

    def propose(kind: str, start: int, end: int, score: float) -> None:
        score += 0.3 * _near(text, start, end, kind)
        if score >= MIN_SCORE and all(is_free(spans, start, end) for spans in held):
            out.append((kind, start, end, round(score, 2)))
            held[1 + ADDED.index(kind)].append((start, end))

    for m in IBAN.finditer(text):
        number = m[0].replace(" ", "")
        n, score = IBAN_LENGTH.get(number[:2]), 0.8
        if n is None:
            ends = (len(m[0][:k].replace(" ", "")) for k in range(len(m[0]), 14, -1) if m[0][k : k + 1] in ("", " "))
            n, score = next((k for k in ends if k >= 15 and mod_97(number[:k])), 0), 0.4
        if n and len(number) >= n and mod_97(number[:n]):
            size = end = 0
            while size < n:
                size, end = size + (m[0][end] != " "), end + 1
            propose("iban", m.start(), m.start() + end, score)
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 15:
            propose("account", *m.span(), 0.1 + 0.3 * luhn(d))
    for m in TEL.finditer(text):
        if 7 <= len(_digits(m[0])) <= 12:
            propose("tel", *m.span(), 0.3)
    for m in SECRET.finditer(text):
        propose("secret", *m.span(), 0.1 + 0.3 * varied(m[0]))
    return out


def written(spans: list[tuple], kinds: tuple[str, ...]) -> str:
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in sorted(spans, key=lambda s: (order[s[0]], s[1])))


def redact(text: str, spans: list[tuple]) -> str:
    out, last, until = [], 0, 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= until:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = until = max(until, b)
    return "".join(out) + text[last:]


def _scan(with_text: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            columns = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base", "spans", "redacted")}
            for text in batch.column("quern_text").to_pylist():
                base = base_spans(text)
                more = added_spans(text, base)
                for k in BASE:
                    columns[f"n_{k}"].append(sum(s[0] == k for s in base))
                columns["base"].append(written(base, BASE))
                columns["spans"].append(written([*base, *more], BASE + ADDED))
                columns["redacted"].append(redact(text, [*base, *more]) if with_text else None)
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            kept = [i for i, name in enumerate(batch.schema.names) if name != "quern_text"]
            made = [pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.StructArray.from_arrays(made, list(columns))], [*(batch.schema.names[i] for i in kept), "quern_pii"])

    return run


PII = StructType([*(StructField(f"n_{k}", LongType()) for k in BASE), *(StructField(k, StringType()) for k in ("base", "spans", "redacted"))])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans (kind:start:end, code points, end exclusive)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("quern_text"))
    return rows.mapInArrow(released(_scan(False)), f"doc_id long, quern_pii {PII.simpleString()}").select("doc_id", "quern_pii.*").drop("redacted")


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs, with each span in the text replaced by its kind in brackets; null text stays null."""
    if not docs.columns:
        return docs
    names = [f"quern_{k}" for k in range(len(docs.columns))]  # the columns' own names may hold dots
    plain = docs.toDF(*names)
    plain = plain.select(*names, whole_text(names[docs.columns.index("text")]).alias("quern_text"))
    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)), StructField("quern_pii", PII)])
    found = plain.mapInArrow(released(_scan(True)), schema)
    new = {"text": F.when(F.col(names[docs.columns.index("text")]).isNotNull(), F.col("quern_pii.redacted"))}
    return found.select(*(new.get(own, F.col(n)).alias(own) for own, n in zip(docs.columns, names, strict=True)))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def brute_force(text: str | None) -> tuple[int, int, int, int, str]:
    """Base spans by the plain patterns, for tests."""
    text = text or ""
    spans = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(_digits(m[0])) <= 15],
    }
    said = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in sorted(spans[k]))
    return (*(len(spans[k]) for k in BASE), hashlib.sha256(said.encode()).hexdigest())
