"""Personal data by anchor expansion.

One Aho-Corasick automaton walks a text once and finds anchors: at-signs, plus signs before
a digit, places where digits meet across at most one separator or a dot, URL schemes, and
words that announce an identifier. From each anchor a local parser goes left and right over
the characters its kind allows and checks what it has found. A parser never looks further
than its own match, so the work follows the text plus the matches.

Base kinds (email, ip, card, phone) are the leftmost, non-overlapping matches of their
patterns, checked, without a second try. Further kinds are added by cue words: account (an
IBAN with a right checksum, or a number after a word for account), ssn (a US social security
number), and url_user (a URL that holds a user name).
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import bound_batches

KINDS = ("email", "ip", "card", "phone", "account", "ssn", "url_user")
BASE = KINDS[:4]

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
GAP = frozenset(" -")
#: Capitals and digits, of which codes consist.
CODE = DIGITS | frozenset(c for c in LETTERS if c.isupper())
#: Words that announce a number of an account or an identity card.
CUES = ("IBAN", "iban", "account", "Account", "acct", "Acct", "SSN", "ssn", "social security", "Social Security")
#: Words, besides those for a number (no, nu...), that may stand between a cue and what it announces.
LABELS = frozenset(("id", "code", "nr", "ref", "reference"))
SCHEMES = ("http://", "https://", "ftp://")


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others by Luhn's rule."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def iban_holds(code: str) -> bool:
    """Whether the code's remainder modulo 97 is 1 after its first four characters move last."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def automaton(gap: frozenset[str] = GAP) -> ahocorasick.Automaton:
    """Anchors by kind; digits next to each other, across a separator or across a dot."""
    found = ahocorasick.Automaton()
    put = lambda word, kind: found.add_word(word, (kind, len(word)))
    put("@", "email")
    for a in DIGITS:
        put("+" + a, "phone")
        for b in DIGITS:
            put(a + "." + b, "ip")
            put(a + b, "card")
            for g in gap:
                put(a + g + b, "card")
    for s in SCHEMES:
        put(s, "url_user")
    for c in CUES:
        put(c, "cue")
    found.make_automaton()
    return found


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign; its left part does not begin before floor."""
    lo, n = at, len(text)
    while lo > floor and text[lo - 1] in LOCAL:
        lo -= 1
    hi = at + 1
    while hi < n and text[hi] in LABEL:
        hi += 1
    if lo == at or hi == at + 1:
        return None
    end = hi
    while end + 1 < n and text[end] == "." and text[end + 1] in LABEL:
        end += 1
        while end < n and text[end] in LABEL:
            end += 1
    return (lo, end) if end > hi else None


def ips_from(text: str, at: int, floor: int) -> tuple[list[tuple[int, int]], int]:
    """Valid matches in the chain of numbers and dots around at, and where the chain ends."""
    lo, n = at, len(text)
    while lo > floor and (text[lo - 1] in DIGITS or text[lo - 1] == "." and lo - 1 > floor and text[lo - 2] in DIGITS):
        lo -= 1
    parts, hi = [], lo
    while True:
        a = hi
        while hi < n and text[hi] in DIGITS:
            hi += 1
        parts.append((a, hi))
        if hi + 1 < n and text[hi] == "." and text[hi + 1] in DIGITS:
            hi += 1
        else:
            break
    out = []
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        small = all(len(x := text[a:b].lstrip("0")) < 3 or len(x) == 3 and x <= "255" for a, b in four)
        if small:
            out.append((four[0][0], four[3][1]))
    return out, hi


def card_from(text: str, at: int, floor: int, gap: frozenset[str] = GAP) -> tuple[int, int, str]:
    """The run of digits with at most one separator between two of them, around at."""
    lo, n = at, len(text)
    while lo > floor:
        if text[lo - 1] in DIGITS:
            lo -= 1
        elif lo - 1 > floor and text[lo - 1] in gap and text[lo - 2] in DIGITS:
            lo -= 2
        else:
            break
    hi = lo + 1
    while hi < n:
        if text[hi] in DIGITS:
            hi += 1
        elif hi + 1 < n and text[hi] in gap and text[hi + 1] in DIGITS:
            hi += 2
        else:
            break
    return lo, hi, "".join(c for c in text[lo:hi] if c in DIGITS)


def phone_at(text: str, at: int) -> tuple[int, int, int] | None:
    """(start, end, digits) of the number that begins with the plus sign at at."""
    hi, n = at + 2, len(text)
    while hi < n and text[hi] in PHONE:
        hi += 1
    while hi > at + 2 and text[hi - 1] not in DIGITS:
        hi -= 1
    if hi < at + 4:
        return None
    return at, hi, sum(c in DIGITS for c in text[at:hi])


def iban_from(text: str, at: int) -> int | None:
    """End of the longest IBAN that begins at at: capitals and digits, a separator between groups."""
    n, hi, size, best = len(text), at, 0, None
    if not (text[at : at + 2].isalpha() and text[at + 2 : at + 4].isdigit()):
        return None
    while hi < n and size < 34:
        if text[hi] in CODE:
            hi, size = hi + 1, size + 1
            if size >= 15 and (hi == n or text[hi] not in CODE) and iban_holds("".join(c for c in text[at:hi] if c in CODE)):
                best = hi
        elif text[hi] in GAP and hi + 1 < n and text[hi + 1] in CODE:
            hi += 1
        else:
            break
    return best


def after_cue(text: str, at: int, met: dict) -> tuple[str, int, int] | None:
    """(kind, start, end) of an identifier that follows a cue word ending at at.

    Between them may be the rest of the cue's own word, label words and what is neither a
    letter nor a digit. The next cue is no label, so what lies behind a word is passed once:
    met keeps the end of the last word in which a cue was, and what has been found behind it.
    """
    if text[at : at + 1] in CODE and (end := iban_from(text, at)):
        return "account", at, end
    if at > met.get("end", -1):
        end, n = at, len(text)
        while end < n and text[end] in LETTERS:
            end += 1
        met["end"], met["found"] = end, behind_word(text, end)
    return met["found"]


def behind_word(text: str, at: int) -> tuple[str, int, int] | None:
    """after_cue() from the end of the cue's word on."""
    n, lo = len(text), at
    while lo < n and text[lo] not in DIGITS:
        if text[lo] not in LETTERS:
            lo += 1
            continue
        if text[lo] in CODE and (end := iban_from(text, lo)):
            return "account", lo, end
        end = lo
        while end < n and text[end] in LETTERS:
            end += 1
        word = text[lo:end].lower()
        if not word.startswith(("no", "nu")) and word not in LABELS:
            return None
        lo = end
    if lo >= n:
        return None
    hi = lo
    while hi < n and (text[hi] in DIGITS or text[hi] in GAP and hi + 1 < n and text[hi + 1] in DIGITS):
        hi += 1
    body = text[lo:hi]
    flat = "".join(c for c in body if c in DIGITS)
    if len(body) >= 11 and [len(p) for p in body[:11].split("-")] == [3, 2, 4] and body[:11].replace("-", "").isdigit() and body[:3] not in ("000", "666"):
        return "ssn", lo, lo + 11
    if (hi == n or text[hi] not in CODE) and 8 <= len(flat) <= 17:
        return "account", lo, hi
    return None


def url_user_at(text: str, at: int) -> tuple[int, int] | None:
    """End of a user part (name, maybe a password, an at-sign) that begins at at."""
    n, hi = len(text), at
    while hi < n and (text[hi] in LOCAL or text[hi] in ":~!$&'*,;="):
        hi += 1
    if hi == at or hi >= n or text[hi] != "@":
        return None
    end = hi + 1
    while end < n and (text[end] in LABEL or text[end] == "."):
        end += 1
    return (at, end) if end > hi + 1 else None


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything found, by start, then kind as listed."""
    out: list[tuple[str, int, int]] = []
    done = {"email": 0, "ip": 0, "card": 0, "phone": 0}
    met: dict = {}
    for last, (kind, size) in anchors.iter(text):
        at = last + 1 - size
        if kind == "email":
            if at >= done["email"] and (m := email_at(text, at, done["email"])):
                out.append(("email", *m))
                done["email"] = m[1]
        elif kind == "ip":
            if at >= done["ip"]:
                found, done["ip"] = ips_from(text, at, done["ip"])
                out += [("ip", *m) for m in found]
        elif kind == "card":
            if at >= done["card"]:
                lo, hi, digits = card_from(text, at, done["card"])
                done["card"] = hi
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", lo, hi))
        elif kind == "phone":
            if at >= done["phone"] and (m := phone_at(text, at)):
                done["phone"] = m[1]
                if 9 <= m[2] <= 15:
                    out.append(("phone", m[0], m[1]))
        elif kind == "url_user":
            if m := url_user_at(text, last + 1):
                out.append(("url_user", *m))
        elif m := after_cue(text, last + 1, met):
            out.append(m)
    return sorted(set(out), key=lambda m: (m[1], KINDS.index(m[0]), m[2]))


_ANCHORS: list[ahocorasick.Automaton] = []


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, found) of each row of docs (columns doc_id, text; null text: empty).

    found is an array of (kind, start, end), places in code points, end exclusive, ordered by
    start, then kind; empty where there is nothing. Rows are independent: no exchange, equal
    rows give equal results, an empty table an empty one. Texts are read whole, however long,
    in time that follows their length; a null doc_id stays null, other columns are ignored.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        if not _ANCHORS:
            _ANCHORS.append(automaton())
        anchors = _ANCHORS[0]
        row = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py() or "", anchors)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(row))], ["doc_id", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")
