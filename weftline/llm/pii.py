"""Personal data, also where it is disguised, with spans in the source text.

Base detectors run on the text itself.  Where a text shows signs of disguise, a
chain of transducers rewrites it: look-alike and full-width characters become
ASCII, invisible ones go, digits spelled in English, German, French or Spanish
become digits, and written-out ``at`` and ``dot``, in these languages too, become
``@`` and ``.``, also where they are glued into one word (``john_at_example_dot_com``) or
letters are spaced out; letters ``O`` and ``l`` among digits become digits, and ``00`` before a
country's number becomes ``+`` where a word like "tel" stands before it.  Each step carries, for every character it
gives out, the source span it came from; the same detectors then run on the
rewritten text and their spans are mapped back.  A span is added only if its
source differs from what was detected and no base span of its kind covers it.

Offsets count code points, ends are exclusive.  Defined results: a null text is
empty and has no spans; a null ``doc_id`` is carried; repeated rows each get
their own row; an empty table gives an empty result; texts are scanned whole, in time proportional to their length.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import per_batch, small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Starting inside a run of digits can't succeed where its start failed, so runs are entered at their start only.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Characters that look like ASCII ones.
LOOK_ALIKES = str.maketrans("авеікмнорстухѕјԁɡοανρυιАВЕІКМНОРСТУХЅЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧ‐‑‒–—−․。＠", "aveikmhopctyxsjdgoavpuiABEIKMHOPCTYXSJABEZHIKMNOPTYX------..@")
INVISIBLE = "­​‌‍⁠﻿"
#: Words for the digits from zero on, in English, German, French and Spanish.
DIGIT_WORDS = {
    word: str(d)
    for d, words in enumerate(
        (
            "zero oh null zéro cero",
            "one eins un uno",
            "two zwei zwo deux dos",
            "three drei trois tres",
            "four vier quatre cuatro",
            "five fünf fuenf cinq cinco",
            "six sechs seis",
            "seven sieben sept siete",
            "eight acht huit ocho",
            "nine neun neuf nueve",
        )
    )
    for word in words.split()
}
#: Words for the signs, in the same languages.
DOT_WORDS, AT_WORDS, PLUS_WORDS = ("dot", "point", "punkt", "punto"), ("at", "arroba", "arobase", "klammeraffe"), ("plus", "más")
FULL_WIDTH = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
OTHER_DIGITS = {base + d: str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
SINGLE = FULL_WIDTH | OTHER_DIGITS | LOOK_ALIKES
ODD_SET = frozenset([chr(c) for c in SINGLE]) | frozenset(INVISIBLE)
ODD = re.compile("[" + "".join(map(re.escape, sorted(ODD_SET))) + "]")
_DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
_DOT, _AT, _PLUS = ("(?:" + "|".join(words) + ")" for words in (DOT_WORDS, AT_WORDS, PLUS_WORDS))
SPELLED = re.compile(rf"(?i)\b(?:({_PLUS})[ -]+)?({_DIGIT}(?:[ ,-]+{_DIGIT}){{3,}}(?:[ ,-]+{_DOT}[ ,-]+{_DIGIT}(?:[ ,-]+{_DIGIT})*)*)\b")
SPELLED_PART = re.compile(rf"(?i)\b({_DIGIT}|{_DOT})\b")
BRACKETED = re.compile(rf"(?i) ?[\[({{<] ?({_AT}|@|{_DOT}|\.) ?[\])}}>] ?")
#: Top-level domains that are no English words: all country codes but those of WORD_CODES, and common general ones.
DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro mobi jobs aero coop museum app dev xyz online site tech shop store cloud eu"
    " ac ad ae af ag ai al ao aq ar au aw ax az ba bb bd bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz"
    " de dj dk dm dz ec ee eg er es et fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im io iq ir je jm jo jp"
    " ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx mz na nc ne nf ng ni nl np nr nu nz"
    " om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn tr tt tv tw tz"
    " ua ug uk uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
#: Country codes that are English words, or as short ones read like words.
WORD_CODES = frozenset("am as at be do gy in is it me my no so to us".split())
ROLES = frozenset("info mail contact kontakt contacto support sales admin office press presse prensa help jobs privacy hello webmaster postmaster".split())
NEAR_MAIL = re.compile(r"(?i)\b(?:e-?mail|mail|contact|address|reach|kontakt|adresse|contacto|correo|courriel|dirección)\b")
AFTER = re.compile(r"\s*(?:[.,;:!?)\]}>\"']|\Z)")
DOT = re.compile(rf"(?i)(?<=\s){_DOT}(?=\s)")
JOIN = re.compile(rf"(?i)\s+{_DOT}\s+")
#: A local part, read backwards.
LOCAL_BACK = re.compile(rf"(?i)[A-Za-z0-9._%+-]+(?:\s+(?:{'|'.join(w[::-1] for w in DOT_WORDS)})\s+[A-Za-z0-9._%+-]+)*")
AT = re.compile(rf"(?i)@|(?<=\s){_AT}(?=\s)")
LABEL = re.compile("[A-Za-z0-9-]+")
DOMAIN_WRITTEN = re.compile(rf"(?i)\s*[A-Za-z0-9-]+(?:(?:\s+{_DOT}\s+|\.)[A-Za-z0-9-]+)+")
IP_DOT = re.compile(rf"(?i)(?<=[0-9])\s+{_DOT}\s+(?=[0-9])")
#: General top-level domains, which no file name ends in.
GENERAL = frozenset("com org net edu gov mil int info biz aero coop museum".split())
#: ``_at_`` or ``-at-`` inside one word; labels and written dots behind it.
GLUED = re.compile(rf"(?i)([_-]){_AT}\1")
GLUED_DOMAIN = {sep: re.compile(rf"(?i)(?:{label})(?:(?:{sep}{_DOT}{sep}|\.)(?:{label}))+") for sep, label in (("_", "[A-Za-z0-9-]+"), ("-", "[A-Za-z0-9]+"))}
GLUED_DOT = {sep: re.compile(rf"(?i){sep}{_DOT}{sep}") for sep in "_-"}
CUES = ("mail", "contact", "reach", "write to", "kontakt", "courriel", "correo")
#: An address after a cue, with nothing but ``at`` written out, and words that are no one's name there.
PLAIN = re.compile(rf"(?i)\b(?:e-?mail|mail|contact|reach|write to|kontakt|contacto|courriel|correo)(?:\s*:|\s+to)?\s+([A-Za-z0-9._%+-]+)\s+{_AT}\s+(?!www\.)([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
NO_NAMES = frozenset("us me him her them you it we one all anyone someone information details page pages form forms person point list lists server servers address addresses book bar data out back there here only also directly now today".split())
#: A label, its letters spaced out or not, and a domain of such labels.
_SPACED_LABEL = r"(?:[A-Za-z0-9-](?:\x20[A-Za-z0-9-])+(?![A-Za-z0-9-])|[A-Za-z0-9-]+)"
SPACED_DOMAIN = re.compile(rf"\x20?{_SPACED_LABEL}(?:(?:\x20\.\x20|\.){_SPACED_LABEL})+")
BLANKS = re.compile(r"\x20")
#: Digits with letters that look like them among them; it can only begin where a run does.
MIXED = re.compile(r"(?<![0-9OoIl][ -])(?<![A-Za-z0-9])[0-9OoIl](?:[ -]?[0-9OoIl])++(?![A-Za-z0-9])")
MIXED_SIGN = re.compile(r"[0-9](?:(?=[OoIl])|(?<=[OoIl][0-9]))")
MIXED_GROUP = re.compile(r"[0-9OoIl]+")
MIXED_LETTER = re.compile(r"[OoIl]")
#: The prefix of international calls.
ZEROS = re.compile(r"(?<![0-9A-Za-z.,+-])00(?=[1-9][0-9]{0,2}[\x20().-]?[0-9])")
NEAR_PHONE = re.compile(r"(?i)\b(?:tel|phone|telephone|telefon|tel[eé]fono|t[eé]l[eé]phone|fon|fax|call|mobile?|handy|m[oó]vil|whatsapp|sms)\b")
#: A secret that stands behind its name: its value is what is found.
SECRET = re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|passwort|pwd|api[_-]?key|access[_-]?key|authorization|bearer)["']?\s*(?:[:=]|\bis\b)\s*(?:bearer\s+)?["']?([A-Za-z0-9_./+=~-]{8,})""")
SECRET_NAMES = ("token", "secret", "passw", "pwd", "key", "authorization", "bearer")
KEY_STARTS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyJ")
#: Secrets that their own form gives away.
KEY = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Each ``@`` with the run of local characters before it and a domain after it; linear in the text."""
    out, free, at = [], 0, t.find("@")
    while at >= 0:
        if at > free and t[at - 1] in LOCAL and (domain := DOMAIN.match(t, at + 1)):
            start = at - 1
            while start > free and t[start - 1] in LOCAL:
                start -= 1
            out.append((start, free := domain.end()))
        at = t.find("@", max(at + 1, free))
    return out


def detect(t: str) -> list[Span]:
    """Spans of every kind, in order of start and then of kind."""
    out: list[tuple[int, int, int]] = [(s, 0, e) for s, e in emails(t)]
    for m in IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(t):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


class Tape:
    """A rewritten text; character i came from source characters ``start[i]`` to ``end[i]``."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, array("q", range(len(text))), array("q", range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, to) -> None:
        """Put ``to(match)``, a string or pieces of (string, from, to), in place of each match."""
        text, start, end, at = [], array("q"), array("q"), 0
        for m in pattern.finditer(self.text):
            text.append(self.text[at : m.start()])
            start += self.start[at : m.start()]
            end += self.end[at : m.start()]
            given = to(m)
            for s, a, b in [(given, m.start(), m.end())] if isinstance(given, str) else given:
                text.append(s)
                start.extend([self.start[a]] * len(s))
                end.extend([self.end[b - 1]] * len(s))
            at = m.end()
        if text:
            self.text, self.start, self.end = "".join(text) + self.text[at:], start + self.start[at:], end + self.end[at:]

    def replace(self, edits: list[tuple[str, int, int]]) -> None:
        """Put each string in place of what it spans."""
        text, start, end, at = [], array("q"), array("q"), 0
        for s, a, b in edits:
            text += [self.text[at:a], s]
            start += self.start[at:a]
            end += self.end[at:a]
            start.extend([self.start[a]] * len(s))
            end.extend([self.end[b - 1]] * len(s))
            at = b
        self.text, self.start, self.end = "".join(text) + self.text[at:], start + self.start[at:], end + self.end[at:]


def _spelled(m: re.Match) -> list[tuple[str, int, int]]:
    out = [("+", m.start(1), m.end(1))] if m[1] else []
    for part in SPELLED_PART.finditer(m.string, m.start(2), m.end(2)):
        out.append((DIGIT_WORDS.get(part[0].lower(), "."), part.start(), part.end()))
    return out


def _sign(m: re.Match) -> str:
    return "@" if m[1].lower() in (*AT_WORDS, "@") else "."


def _written(tape: Tape) -> list[tuple[str, int, int]]:
    # The signs of written-out addresses in a tape, each with its place; linear in the text.
    t, out, floor, scanned = tape.text, [], 0, 0
    back = t[::-1]
    for m in AT.finditer(t):
        if m.start() < scanned or not (domain := DOMAIN_WRITTEN.match(t, m.end())):
            continue
        scanned = domain.end()
        left = m.start()
        while left > floor and t[left - 1].isspace():
            left -= 1
        local = LOCAL_BACK.match(back, len(t) - left, len(t) - floor)
        if not local:
            continue
        start, sign = len(t) - local.end(), m[0] == "@"
        joins = [(j.start(), j.end()) for j in JOIN.finditer(t, m.end(), domain.end())]
        tight = sign and left == m.start() and not t[m.end()].isspace()
        wide = tape.end[m.start()] - tape.start[m.start()] > 1
        if not joins and not (tight and wide):
            continue
        inner = [(j.start(), j.end()) for j in JOIN.finditer(t, start, left)]
        clear = sign or bool(inner) or bool(NEAR_MAIL.search(t, max(floor, start - 40), start))
        end = domain.end() if tight else _domain_end(t, m.end(), domain, clear or t[start:left].lower() in ROLES, clear)
        if not end:
            continue
        right = m.end()
        while t[right].isspace():
            right += 1
        edits = [(".", a, b) for a, b in inner] + [("@", left, right)] + [(".", a, b) for a, b in joins if b < end]
        out += edits
        floor = scanned = end
    return out


def _domain_end(t: str, begin: int, domain: re.Match, likely: bool, clear: bool) -> int:
    # Where the longest domain ends whose last label may be a top-level domain here; 0 without.
    labels = list(LABEL.finditer(t, begin, domain.end()))
    names = [x for x in labels if not (x[0].lower() in DOT_WORDS and t[x.start() - 1].isspace() and t[x.end() : x.end() + 1].isspace())]
    for k in range(len(names) - 1, 0, -1):
        name, end = names[k][0].lower(), names[k].end()
        if name in DOMAINS or name in WORD_CODES and (likely or k > 1 or AFTER.match(t, end)) or clear and len(name) > 1 and name.isalpha():
            return end
    return 0


def _glued(t: str) -> list[tuple[str, int, int]]:
    # The signs of addresses that are glued into one word; linear, for labels end at separators.
    out, floor = [], 0
    for m in GLUED.finditer(t):
        domain = m.start() > floor and t[m.start() - 1] in LOCAL and GLUED_DOMAIN[m[1]].match(t, m.end())
        if not domain:
            continue
        dots = [d.span() for d in GLUED_DOT[m[1]].finditer(t, m.end(), domain.end())]
        last = LABEL.findall(domain[0].replace("_", " "))[-1].rpartition("-")[2].lower()
        if last in (DOMAINS if dots else GENERAL) and (dots or m[1] == "_"):
            out += [("@", *m.span()), *((".", a, b) for a, b in dots)]
            floor = domain.end()
    return out


def _plain(t: str) -> list[tuple[str, int, int]]:
    # The word for ``@`` of addresses that a cue announces.
    return [("@", m.end(1), m.start(2)) for m in PLAIN.finditer(t) if m[1].lower() not in NO_NAMES and m[2].rpartition(".")[2].lower() in DOMAINS]


def _spaced(t: str) -> list[tuple[str, int, int]]:
    # The blanks of addresses whose letters or signs stand apart.
    out, floor, at = [], 0, t.find("@")
    while at >= 0:
        domain = SPACED_DOMAIN.match(t, at + 1)
        left = at - 1 if at and t[at - 1] == " " else at
        if domain and left > floor and t[left - 1] in LOCAL:
            start = left - 1
            while start - 2 >= floor and t[start - 1] == " " and t[start - 2] in LOCAL and (start - 2 == 0 or t[start - 3] not in LOCAL):
                start -= 2
            single = start - 1 < floor or t[start - 1] not in LOCAL
            letters = single and left - start >= 5
            apart = " . " in domain[0]
            # The last label may run into letters that follow it.
            cut = max(domain[0].rfind("."), 0) + 1
            tail = domain[0][cut:]
            lead = len(tail) - len(tail.lstrip(" "))
            ends = [n for n in range(len(tail), lead, -1) if tail[:n].replace(" ", "").lower() in DOMAINS and (n == len(tail) or tail[n] == " ")]
            if (letters or apart) and ends:
                end = domain.start() + cut + ends[0]
                begin = start if letters else left
                out += [("", *b.span()) for b in BLANKS.finditer(t, begin, end)]
                floor = at = end - 1
        at = t.find("@", at + 1)
    return out


def _mixed(t: str) -> list[tuple[str, int, int]]:
    # Letters among digits, in runs as long as the shortest number; each group has a digit, and digits are two of three.
    out = []
    for m in MIXED.finditer(t):
        groups = [g.span() for g in MIXED_GROUP.finditer(t, *m.span())]
        real = [any(c.isdigit() for c in t[a:b]) for a, b in groups]
        while groups and not real[0]:
            del groups[0], real[0]
        while groups and not real[-1]:
            del groups[-1], real[-1]
        n = sum(b - a for a, b in groups)
        letters = [x for a, b in groups for x in MIXED_LETTER.finditer(t, a, b)]
        if n >= 10 and all(real) and letters and 3 * len(letters) <= n:
            out += [("0" if x[0] in "Oo" else "1", *x.span()) for x in letters]
    return out


def _called(t: str) -> list[tuple[str, int, int]]:
    # ``00`` that stands for a plus.
    return [("+", *m.span()) for m in ZEROS.finditer(t) if NEAR_PHONE.search(t, max(0, m.start() - 30), m.start())]


def _has_run(low: str) -> bool:
    """Whether two neighbouring words are digits' names and nothing more, as any two inside a spelled number are."""
    at = [i for i, w in enumerate(low.replace("-", " ").replace(",", " ").split()) if w in DIGIT_WORDS]
    return any(b - a == 1 for a, b in zip(at, at[1:], strict=False))


def disguised(t: str) -> list[Span]:
    """Spans found only once disguises are undone; those that the base detectors see are left out by the caller."""
    low = t.lower()
    odd = not (t.isascii() or ODD_SET.isdisjoint(set(t)))
    # Words and signs are looked for plainly first; most texts have none of them.
    bracketed = any(c in t for c in "[({<") and BRACKETED.search(t)
    written = any(w in low for w in DOT_WORDS) and DOT.search(t)
    spelled = _has_run(low) and SPELLED.search(t)
    glued = any(f"{c}{w}{c}" in low for c in "_-" for w in AT_WORDS)
    plain = any(w in low for w in CUES) and PLAIN.search(t)
    spaced = "@" in t and (" @" in t or "@ " in t)
    mixed = MIXED_SIGN.search(t)
    called = "00" in t and ZEROS.search(t)
    if not (odd or bracketed or written or spelled or glued or plain or spaced or mixed or called):
        return []
    tape = Tape(t)
    if odd:
        tape.rewrite(ODD, lambda m: "" if m[0] in INVISIBLE else str(SINGLE.get(ord(m[0])) if not isinstance(SINGLE.get(ord(m[0])), int) else chr(SINGLE[ord(m[0])])))
    tape.rewrite(SPELLED, _spelled)
    tape.rewrite(BRACKETED, _sign)
    tape.replace(_written(tape))
    tape.rewrite(IP_DOT, lambda m: ".")
    for edits in (_glued, _plain, _spaced, _mixed, _called):
        if found := edits(tape.text):
            tape.replace(found)
    out = []
    for kind, s, e in detect(tape.text):
        source = (tape.start[s], tape.end[e - 1])
        if t[slice(*source)] != tape.text[s:e]:
            out.append((kind, *source))
    return out


def find(t: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = detect(t)
    more = [x for x in disguised(t) if not any(k == x[0] and s <= x[1] and x[2] <= e for k, s, e in base)]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + more, key=lambda x: (x[1], order[x[0]], x[2])) if more else base


def secrets(t: str) -> list[tuple[int, int]]:
    """Spans of passwords, tokens and keys, in order, none inside another."""
    low = t.lower()
    found = [m.span(1) for m in SECRET.finditer(t)] if any(w in low for w in SECRET_NAMES) else []
    if any(w in t for w in KEY_STARTS):
        found += [m.span() for m in KEY.finditer(t)]
    out, at = [], 0
    for s, e in sorted(found):
        if s >= at:
            out.append((s, at := e))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_found); the counts of kinds are of base spans.

    ``n_secret`` counts passwords, tokens and keys, which ``spans`` leaves out; ``n_found`` counts them and all spans.
    """

    def make():
        def one(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans, hidden, found = [], [], [], []
            for t in texts.to_pylist():
                base, every = find(t) if t else ([], [])
                for n, k in zip(counts, KINDS, strict=True):
                    n.append(sum(x[0] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                hidden.append(len(secrets(t)) if t else 0)
                found.append(hidden[-1] + len(every))
            arrays = [keys, *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(hidden, pa.int64()), pa.array(found, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["k", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_secret", "n_found"])

        return one

    small_batches(docs.sparkSession)
    schema = f"k {dict(docs.dtypes)[key]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_found long"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(per_batch(make, ["k", "t"]), schema).withColumnRenamed("k", key)


def masked(t: str) -> str:
    """The text with ``[KIND]`` in place of each span and ``[SECRET]`` of each secret; overlapping spans make one, named for the first."""
    out, at = [], 0
    spans = find(t)[1]
    if hidden := secrets(t):
        spans = sorted([*spans, *(("secret", s, e) for s, e in hidden)], key=lambda x: (x[1], -x[2]))
    for i, (kind, s, e) in enumerate(spans):
        if s < at:
            continue
        for _, s2, e2 in spans[i + 1 :]:
            if s2 >= e:
                break
            e = max(e, e2)
        out += [t[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + t[at:] if out else t


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` masked; other columns and null texts stay."""
    names = docs.columns
    small_batches(docs.sparkSession)

    def make():
        def one(*columns: pa.Array) -> pa.RecordBatch:
            at = names.index(text)
            new = pa.array([masked(t) if t else t for t in columns[at].to_pylist()], columns[at].type)
            return pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(columns)], names=names)

        return one

    return docs.mapInArrow(per_batch(make, names), docs.schema)
