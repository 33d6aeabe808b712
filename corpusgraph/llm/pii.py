"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, URL schemes, identifier cues,
and the two or three characters that any number of a numeric kind must hold (a dot or
plus before a digit, two digits side by side or with one separator between). Local parsers expand
each anchor to the span it belongs to and validate its boundary (domain labels, IBAN
check digits, Luhn, part ranges, digit counts). Text without anchors is never parsed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of results; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "account", "secret", "url")
BASE_KINDS = KINDS[:4]

#: Cues that announce an account number and those that announce a secret.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "social security", "passport", "tax id", "customer id", "driver license")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api key", "access_key", "private_key", "bearer")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = "0123456789"
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AFTER_CUE = re.compile(r"(?:[ _-]?(?:number|no|nr|id|key))?[\x20\t]{0,3}(?:[:=#]|is\b)?[\x20\t]{0,3}[\"']?")
# a token with a digit, then such tokens (a bank's letters may come between), whatever their number
_ACCOUNT = re.compile(r"[A-Za-z]*+[0-9][0-9A-Za-z]*+(?:[\x20./-](?:[A-Z]{1,4}[\x20./-])?[A-Z]*+[0-9][0-9A-Z]*+(?![a-z]))*+")
_SECRET = re.compile(r"[^\s\"'`]+")
_CLOSING = ",;)]}>"
_URL_END = re.compile(r"[\s\"'<>|\\^`{}]")
#: Characters after an IBAN's cue that can belong to it: 34, and separators.
_IBAN_REACH = 70


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for cue in ("@", "://", "tel:", *ACCOUNT_CUES, *SECRET_CUES):
        found.add_word(cue, cue)
    for d in _DIGITS:
        found.add_word(f".{d}", ".")
        found.add_word(f"+{d}", "+")
        for gap in ("", " ", "-"):
            for e in _DIGITS:
                found.add_word(f"{d}{gap}{e}", "0")
    found.make_automaton()
    return found


def _folded(text: str) -> str:
    """Lower case, position by position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int(x) * 2 - 9 * (x > "4") for x in digits[-2::-2])) % 10 == 0


def iban(value: str) -> bool:
    plain = value.replace(" ", "").upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", plain)) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _left_word(text: str, at: int, low: int) -> int:
    while at > low and _LOCAL.match(text, at - 1):
        at -= 1
    return at


def _emails(text: str, marks: list[int]) -> Iterator[tuple[int, int]]:
    done = 0
    for at in marks:
        if at < done or not (found := _DOMAIN.match(text, at + 1)):
            continue
        start = _left_word(text, at, done)
        if start < at:
            done = found.end()
            yield start, done


def _addresses(text: str, marks: list[int]) -> Iterator[tuple[int, int]]:
    """IP addresses; ``marks`` are the digits after a dot."""
    done = 0  # end of the run of digits and dots that was parsed last
    for at in marks:
        if at < done:
            continue
        start = at
        while start > done and (text[start - 1] in _DIGITS or text[start - 1] == "."):
            start -= 1
        done = at + 1
        while done < len(text) and (text[done] in _DIGITS or text[done] == "."):
            done += 1
        chain: list[tuple[int, int]] = []
        for part in re.finditer(r"[0-9]+", text[start:done]):
            if chain and part.start() != chain[-1][1] + 1:
                chain = []
            chain.append(part.span())
            if len(chain) == 4:
                if all(int(text[start + a : start + b].lstrip("0")[:4] or 0) <= 255 for a, b in chain):
                    yield start + chain[0][0], start + chain[3][1]
                chain = []  # the next address starts after this one, whether it is valid or not


def _cards(text: str, marks: list[int]) -> Iterator[tuple[int, int]]:
    """Card numbers; ``marks`` are digits with another one before them."""
    done = 0
    for at in marks:
        if at < done:
            continue
        start = at
        while True:  # to the left end of the run of digits with single separators
            if start > done and text[start - 1] in _DIGITS:
                start -= 1
            elif start > done + 1 and text[start - 1] in " -" and text[start - 2] in _DIGITS:
                start -= 2
            else:
                break
        done = at + 1
        while done < len(text):
            if text[done] in _DIGITS:
                done += 1
            elif text[done] in " -" and done + 1 < len(text) and text[done + 1] in _DIGITS:
                done += 2
            else:
                break
        if done - start >= 13:
            digits = text[start:done].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield start, done


def _phones(text: str, marks: list[int]) -> Iterator[tuple[int, int]]:
    """Phone numbers; ``marks`` are plus signs before a digit."""
    done = 0
    for at in marks:
        if at >= done and (found := _PHONE.match(text, at)):
            done = found.end()
            if 9 <= sum(map(str.isdigit, found.group())) <= 15:
                yield found.span()


def _values(text: str, cues: list[tuple[int, str]], kinds: tuple[str, ...]) -> Iterator[tuple[str, int]]:
    """Where the values after the cues of ``kinds`` begin; a cue inside a word is none."""
    for end, cue in cues:
        if cue in kinds and not (end > len(cue) and text[end - len(cue) - 1].isalnum()):
            yield cue, _AFTER_CUE.match(text, end).end()


def _accounts(text: str, cues: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
    """Account numbers of six digits or more, to their last token. A cue inside the run that was read last
    has no value of its own: it is in that span, or the run has too few digits."""
    done = 0
    for cue, at in _values(text, cues, ACCOUNT_CUES):
        if at < done:
            continue
        if cue == "iban":  # the longest beginning that ends a token and has valid check digits
            if value := _ACCOUNT.match(text, at, at + _IBAN_REACH):
                stop = value.end()
                ends = [stop, *(k for k in range(stop - 1, at, -1) if text[k] in " ./-")]
                if stop := next((k for k in ends if iban(text[at:k]) and not text[k : k + 1].isalnum()), 0):
                    done = stop
                    yield at, stop
        elif value := _ACCOUNT.match(text, at):
            done = value.end()
            if sum(map(str.isdigit, value.group())) >= 6:
                yield value.span()


def _secrets(text: str, cues: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
    """Secrets: eight characters or more up to white space or a quote, with a digit among other characters;
    after an equals sign, a colon or a quote any that isn't a plain word, and in quotes any. A cue
    inside the run that was read last is its rest."""
    done = 0
    for _, at in _values(text, cues, SECRET_CUES):
        if at < done or not (value := _SECRET.match(text, at)):
            continue
        done = stop = value.end()
        while stop > at and text[stop - 1] in _CLOSING:
            stop -= 1
        if stop - at < 8:
            continue
        value, quoted = text[at:stop], text[at - 1] in "\"'"
        mixed = any(map(str.isdigit, value)) and not value.isdigit()
        if quoted or mixed or (_set(text, at) and not value.rstrip(".!?:").isalpha()):
            yield at, stop


def _set(text: str, at: int) -> bool:
    """Whether an equals sign or a colon stands before ``at``, perhaps with spaces between."""
    while at > 0 and text[at - 1] in " \t":
        at -= 1
    return at > 0 and text[at - 1] in ":="


def _urls(text: str, schemes: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
    """URLs with a user in them, and ``tel:`` ones, to the end of their run. A run is measured once, however
    many schemes it has; a user is looked for between a scheme and the next slash."""
    done = last = floor = 0  # the end of the run of the last scheme, without closing marks, and the scheme's own
    for at, cue in schemes:
        if at >= done:
            found = _URL_END.search(text, at)
            done = last = found.start() if found else len(text)
            while last > at and text[last - 1] in ".,;:!?)":
                last -= 1
        start = at
        if cue == "://":
            while start > floor and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
                start -= 1
            slash = text.find("/", at + 3, done)
            if text.find("@", at + 3, slash if slash >= 0 else done) < 0:
                floor = at + 1
                continue
        floor = at + 1
        yield start, max(last, start)


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans ``(start, end)`` in code points of each kind, by start; a null or empty
    text has none."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    marks, dots, digits, pluses, schemes, cues = [], [], [], [], [], []
    for last, cue in _anchors().iter(_folded(text)):
        if cue == "@":
            marks.append(last)
        elif cue == "0":
            digits.append(last)
        elif cue == ".":
            dots.append(last)
        elif cue == "+":
            pluses.append(last - 1)
        elif cue in ("://", "tel:"):
            schemes.append((last + 1 - len(cue), cue))
        else:
            cues.append((last + 1, cue))
    out["email"] = list(_emails(text, marks))
    out["ip"], out["card"], out["phone"] = list(_addresses(text, dots)), list(_cards(text, digits)), list(_phones(text, pluses))
    out["account"], out["secret"], out["url"] = list(_accounts(text, cues)), list(_secrets(text, cues)), list(_urls(text, schemes))
    for kind in KINDS[4:]:
        kept: list[tuple[int, int]] = []
        for span in sorted(set(out[kind])):
            if not kept or span[0] >= kept[-1][1]:
                kept.append(span)
        out[kind] = kept
    return out


def spans_text(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...] = KINDS) -> str:
    """``kind:start:end`` by kind as listed, then start, joined with commas."""
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redacted(text: str | None) -> str | None:
    """``text`` with each span (overlapping ones as one) replaced by ``[KIND]``."""
    if not text:
        return text
    out, done = [], 0
    for start, end, kind in sorted((a, b, k) for k, v in find(text).items() for a, b in v):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:] if out else text


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the number of spans of each kind (``n_email``, ...),
    ``base_sha256, spans``. Only the two named columns are read. A null text counts as empty:
    zeros, the digest of nothing, no spans. Repeated and null ids are kept as they are; an
    empty table gives no rows."""
    counts = [f"n_{k}" for k in KINDS]
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in counts) + ", base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([len(x[k]) for x in found], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(spans_text(x, BASE_KINDS).encode()).hexdigest() for x in found], pa.string()),
                    pa.array([spans_text(x) for x in found], pa.string()),
                ],
                names=["doc_id", *counts, "base_sha256", "spans"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced (``n_chars``, if there, follows);
    all other columns and all rows stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([redacted(x.as_py()) for x in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), clean)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
