"""Garbled forms of a word: what wrong decodings make of it.

A chain is a way from a clean word to what a reader sees: the bytes of one
encoding, read as another, possibly twice. Kinds of chains:

* `wide`: a multi-byte encoding read byte by byte. The form is longer than the
  word, and there is no doubt which of the two is the clean one.
* `same`: one character for another. The chain in the other direction exists as
  well, so the form alone does not tell which of the two is clean.
* `lossy`: replacement characters stand where bytes could not be read.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

#: Encodings of one byte a character, as bytes were written or read.
SINGLE = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "cp437", "cp850", "cp852", "mac-roman", "cp1253", "cp1254", "cp1257")
#: Encodings of several bytes a character.
MULTI = ("utf-8", "cp932", "euc-jp", "gbk", "big5", "euc-kr")
REPLACED = "\ufffd"
SPACE = " \t\n\r\f\v"
#: Characters a reader may turn into a plain space, and so into the end of a word.
SOFT_SPACE = re.compile("[\u00a0\u0085\u3000]")
RUN = re.compile("[^\x00-\x7f]+")
DIGITS = re.compile("[0-9]+")
#: Characters of East Asian scripts.
EAST = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\uff00-\uffef]")
#: Characters that a chance reading of two bytes as UTF-8 gives more often than a text has them.
UNUSUAL = re.compile("[^\x00-\x7f\u00a0-\u024f\u0370-\u045f\u1e00-\u1eff\u2010-\u22ff\u2500-\u25ff\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffef]")
#: A question mark inside a word, as a writer leaves it for a character that the encoding lacks.
QUESTION = re.compile(r"[^\W\d_]\?[^\W\d_]")
WORD_BREAK = re.compile(f"[{SPACE}]+")


@lru_cache(None)
def _table(encoding: str, undefined: str) -> list[str]:
    """What each byte reads as. Where the encoding has no character: the control character of that number (`control`), the replacement character (`replace`) or nothing (`ignore`)."""
    out = []
    for byte in range(256):
        try:
            out.append(bytes([byte]).decode(encoding))
        except UnicodeDecodeError:
            out.append({"control": chr(byte), "replace": REPLACED, "ignore": ""}[undefined])
    return out


@lru_cache(None)
def _has_holes(encoding: str) -> bool:
    return REPLACED in _table(encoding, "replace")


@lru_cache(None)
def _reader(encoding: str, undefined: str) -> tuple[str, bytes]:
    """A table of 256 characters, and the bytes that are left out before it is used."""
    table = _table(encoding, undefined)
    return "".join(c or "?" for c in table), bytes(i for i, c in enumerate(table) if not c)


def _write(text: str, encoding: str) -> bytes | None:
    """Bytes of a text; control characters that stand for undefined bytes are these bytes."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        pass
    if encoding in SINGLE and _has_holes(encoding):
        out = bytearray()
        for char in text:
            try:
                out += char.encode(encoding)
            except UnicodeEncodeError:
                if not 0x80 <= ord(char) < 0xA0:
                    return None
                out.append(ord(char))
        return bytes(out)
    return None


def _read(data: bytes, encoding: str, undefined: str = "control") -> str:
    table, left_out = _reader(encoding, undefined)
    return codecs.charmap_decode(data.translate(None, left_out) if left_out else data, "strict", table)[0]


def once(word: str) -> Iterator[tuple[str, str, str]]:
    """form, chain, kind of one wrong decoding; a form may come twice."""
    east = EAST.search(word) is not None
    for source in (*MULTI, *SINGLE):
        multi = source in MULTI
        if multi and source != "utf-8" and not east:
            continue  # these encodings hold Greek and Cyrillic too, but nobody writes such words in them
        data, marked = _write(word, source), False
        if data is None:
            if multi or source not in ("cp437", "cp850", "cp866", "cp852", "latin-1", "cp1252"):
                continue
            data, marked = word.encode(source, "replace"), True  # question marks for what the encoding lacks
            if data.count(b"?") > 0.5 * sum(ord(c) > 127 for c in word):
                continue
        for target in SINGLE:
            if target == source:
                continue
            for undefined in ("control", "replace", "ignore") if _has_holes(target) else ("control",):
                form = _read(data, target, undefined)
                if form != word:
                    kind = "lossy" if REPLACED in form else "wide" if multi and len(form) > len(word) and undefined != "ignore" else "same"
                    yield form, f"{source}>{target}" + "?" * marked, kind
        if source != "utf-8":
            form = data.decode("utf-8", "replace")
            if REPLACED in form:
                yield form, f"{source}>utf-8" + "?" * marked, "lossy"
    data = word.encode("utf-8", "replace")
    yield data.decode("ascii", "replace"), "utf-8>ascii", "lossy"
    for target in ("cp932", "gbk", "big5", "euc-kr", "euc-jp"):
        form = data.decode(target, "replace")
        if form != word:
            yield form, f"utf-8>{target}", "lossy" if REPLACED in form else "same"


#: What is read wrongly twice in practice: UTF-8 both times.
TWICE = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "cp437", "cp850", "mac-roman", "cp1254")


def twice(word: str) -> Iterator[tuple[str, str, str]]:
    data = word.encode("utf-8", "replace")
    for first in TWICE:
        seen = set()
        for undefined in ("control", "replace") if _has_holes(first) else ("control",):
            middle = _read(data, first, undefined)
            if middle in seen:
                continue
            seen.add(middle)
            again = middle.encode("utf-8", "replace")
            for second in TWICE:
                for last in ("control", "replace") if _has_holes(second) else ("control",):
                    form = _read(again, second, last)
                    yield form, f"utf-8>{first}>utf-8>{second}", "lossy" if REPLACED in form and REPLACED not in middle and first == second else "wide"


def one_character(word: str) -> Iterator[tuple[str, str, str]]:
    """Forms in which one character alone was read wrongly, where it stands beside others beyond ASCII; alone it is a run of its own."""
    for run in RUN.finditer(word):
        if len(run.group()) < 2:
            continue
        for at in range(run.start(), run.end()):
            data = word[at].encode("utf-8", "replace")
            for target in TWICE:
                yield word[:at] + _read(data, target) + word[at + 1 :], f"utf-8>{target}", "wide"


def looks_garbled(word: str) -> bool:
    """Whether the word itself reads as UTF-8 bytes of usual characters in one of the usual targets, or as ASCII in UTF-16."""
    for target in TWICE:
        data = _write(word, target)
        if data is not None:
            try:
                clean = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if clean != word and not UNUSUAL.search(clean):
                return True
    return any(utf16_text(run) is not None for run in ASCII_PAIR.findall(word))


#: Any character at which a form falls into pieces.
BREAK = re.compile(f"[{SPACE}\u00a0\u0085\u3000]")


def _pieces(form: str, word: str) -> list[str]:
    if not BREAK.search(form):
        return [form] if form not in word else []
    pieces = WORD_BREAK.split(form)
    if SOFT_SPACE.search(form):
        pieces += [p for p in SOFT_SPACE.split(form) if len(p) > 1]
    return [p for p in pieces if p not in word]  # what stands beside the space may be clean


def forms_and_chains(word: str, is_run: bool) -> dict[str, tuple[str, str, list[str] | None]]:
    """form -> (chain, kind, chains), the surest kind first; also the parts of a form that a soft space divides, if they have characters beyond ASCII.

    `chains`, of kind `same` only, are all chains of that kind that make the
    form of the word, question marks or not.
    """
    out: dict[str, tuple[str, str]] = {}
    ways: dict[str, set[str]] = {}
    rank = {"wide": 0, "lossy": 1, "same": 2}
    for form, chain, kind in (*once(word), *(() if looks_garbled(word) else twice(word)), *(() if is_run else one_character(word))):
        for piece in _pieces(form, word):
            if kind == "same":
                ways.setdefault(piece, set()).add(chain.rstrip("?"))
            if piece and (not piece.isascii() or (chain[-1] == "?" and QUESTION.search(piece))) and (piece not in out or rank[kind] < rank[out[piece][1]]):
                out[piece] = chain, kind
    return {f: (chain, kind, sorted(ways[f]) if kind == "same" else None) for f, (chain, kind) in out.items()}


def forms(word: str, is_run: bool) -> dict[str, tuple[str, str]]:
    """form -> (chain, kind)."""
    return {f: x[:2] for f, x in forms_and_chains(word, is_run).items()}


def normal(token: str) -> str:
    """Runs of digits do not tell words apart; no encoding here touches them."""
    return DIGITS.sub("0", token)


def with_digits(word: str, token: str) -> str | None:
    """A normalised word with the digits of a token; null if there are not as many runs."""
    digits = DIGITS.findall(token)
    if len(DIGITS.findall(word)) != len(digits):
        return None
    found = iter(digits)
    return DIGITS.sub(lambda _: next(found), word)


KANA = re.compile("[\u3040-\u30ff]")
TEXT_CHAR = re.compile(r"[\w\s.,:;=()\[\]/+-]", re.ASCII)
SMALL = re.compile("[a-z ]")
#: Characters of two printable ASCII bytes each, four or more in a row.
ASCII_PAIR = re.compile("[\u2020-\u7e7e]{4,}")


def utf16_text(run: str) -> str | None:
    """The ASCII text whose bytes read as UTF-16 (either byte order) give the run, if it is a text.

    Chance pairs of printable characters, as East Asian text may give, have few
    spaces and small letters; in kana every second one is a 0.
    """
    if 2 * len(KANA.findall(run)) > len(run):
        return None
    for order in ("utf-16-le", "utf-16-be"):
        try:
            text = run.encode(order).decode("ascii")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if len(TEXT_CHAR.findall(text)) >= 0.9 * len(text) and (len(run) >= 8 or 2 * len(SMALL.findall(text)) >= len(text)):
            return text
    return None
