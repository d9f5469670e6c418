"""Personal data by boosted trees over candidate spans.

Exact patterns give the base spans, which always stay. Besides, generators of high
recall propose overlapping candidates of other notations ("name at host dot com",
"192[.]0[.]2[.]7", "5500.0000.0000.0004", "(030) 555-0199") and of other kinds
(IPv6 addresses, account numbers, national numbers, passwords and keys); trees
boosted on the logistic loss score each by its format and context; those over a
threshold that held-out rows calibrate are taken, best first, where they overlap
nothing taken.

The trees are trained here on spans written by the rules below, since no labels
of personal data exist: notations of each kind in and out of fitting context, and
look-alikes such as dates, versions, amounts, part numbers and formulas. The
precision calibrated is therefore that on such writing; tests measure recall and
precision on notations and prose that the rules don't write.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import cache
from hashlib import sha256
from ipaddress import IPv6Address

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ROW, map_rows, numbered

#: The kinds of base spans, then those that only the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "id", "key")
#: Precision on held-out rows that the threshold must reach.
PRECISION = 0.98
#: Characters of a candidate by which its format is described.
FORMAT = 64
#: Characters on either side of a candidate that its context features see.
CONTEXT = 40

AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def byte_part(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 4 and int(s or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, by start, then kind; each kind leftmost and non-overlapping."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        # the local part is the run of its characters before the @; a match may not reach into the one before it
        start = at
        while start > last and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        if start < at and (m := AT_DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)  # the next local part can't reach over this @
        at = text.find("@", last)
    for m in IP.finditer(text):
        if all(map(byte_part, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= len(m[0]) <= 37 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


AT, DOT = r"(?:@|\(at\)|\[at\]|\{at\}|\bat\b)", r"(?:\.|\(dot\)|\[dot\]|\[\.\]|\{dot\}|\bdot\b)"
NAMED = r"(?:key|token|secret|passw(?:or)?d|passwort|pwd|credential|bearer|contraseña|clave|mot de passe)"
#: (kind, pattern); a candidate is the group "v" where the pattern has one, else the whole match. Lengths are bounded
#: where the notation is: 64 characters of a mailbox, 63 of a label, four dots of a host, 64 characters between what
#: names a key and its sign. Keys themselves may have any length.
GENERATORS = (
    (0, re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}} {{0,1}}{AT} {{0,1}}[A-Za-z0-9-]{{1,63}}(?: {{0,1}}{DOT} {{0,1}}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.I)),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\{\.\}|\{dot\}|\bdot\b) ?[0-9]{1,3}){3}(?![0-9])", re.I)),
    (1, re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")),
    (2, re.compile(r"(?<![0-9A-Za-z])(?<![0-9][.,/-])[0-9]{4}(?:[ ._/-]{0,3}[0-9]{4}){2}[ ._/-]{0,3}[0-9]{1,7}(?![0-9A-Za-z])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}[ ._/-]{1,3}[0-9]{6}[ ._/-]{1,3}[0-9]{5}(?![0-9])")),
    (3, re.compile(r"(?<![0-9A-Za-z+.,-])\(?0{0,2}[0-9]{1,4}\)?(?:(?: ?/ ?|[ .-]{1,2}|[ ./-]{1,2})\(?[0-9]{1,8}\)?){1,6}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z+.,-])\([0-9]{2,6}\)[0-9]{2,8}(?:[ ./-]{1,2}[0-9]{1,8}){0,4}(?![0-9A-Za-z])")),
    (3, re.compile(r"\+ ?\(?[0-9]{1,3}\)?(?:[ ./‐-―-]{0,2}\(?[0-9]{2,5}\)?){2,6}(?![0-9A-Za-z])")),
    (4, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ -]?[0-9A-Z]){11,30}(?![0-9A-Za-z])")),
    (5, re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])")),
    (5, re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{8}|[XYZ][0-9]{7})[ -]?[A-Z](?![0-9A-Za-z])")),
    (5, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}(?: ?[0-9]{2}){3} ?[A-D](?![0-9A-Za-z])")),
    (5, re.compile(r"(?<![0-9A-Za-z])[12](?: ?[0-9]{2}){3}(?: ?[0-9]{3}){2}(?: ?[0-9]{2})?(?![0-9A-Za-z])")),
    (6, re.compile(rf"{NAMED}[A-Za-z0-9_]{{0,64}}[\"']?\s{{0,3}}(?:=>|:=|[=:]|\bis\b|\best\b|\bist\b|\bes\b)?\s{{0,3}}[\"']?(?P<v>[^\s\"'<>(),;]{{8,}}+)", re.I | re.A)),
    (6, re.compile(r"(?:(?<![0-9A-Za-z])AKIA[0-9A-Z]{12,}+|(?<![0-9A-Za-z_-])(?:gh[pousr]_[0-9A-Za-z]{16,}+|xox[abprs]-[0-9A-Za-z-]{10,}+|sk-[0-9A-Za-z_-]{16,}+|eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+(?:\.[0-9A-Za-z_-]*+)?))(?![0-9A-Za-z])")),
    (6, re.compile(r"(?<![0-9A-Za-z])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])")),
    (6, re.compile(r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:[^-]*+-----END [A-Z ]{0,32}PRIVATE KEY-----)?")),
)
AT_LABEL_DOT = re.compile(rf"{AT} {{0,1}}[A-Za-z0-9-]{{1,63}} {{0,1}}{DOT}", re.I)
DOT_BEFORE_LABEL = re.compile(rf" ?{DOT} ?(?=[A-Za-z0-9-]{{2}})", re.I)
NAMES, PREFIXES = ("key", "token", "secret", "passw", "pwd", "credential", "bearer", "contraseña", "clave", "mot de passe"), ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "eyJ")


def proposing(text: str) -> list[int]:
    """The places in ``GENERATORS`` of those that may match: each of the others needs something that the text hasn't."""
    digit, lower = re.search("[0-9]", text) is not None, text.lower()
    there = {0: AT_LABEL_DOT.search(text), 2: "::" in text or digit and text.count(":") > 1 or re.search(":[A-Fa-f]{0,4}:", text), 13: any(n in lower for n in NAMES), 14: any(n in text for n in PREFIXES), 16: "PRIVATE KEY" in text}
    return [k for k in range(len(GENERATORS)) if there.get(k, digit)]


HINTS = (
    re.compile(r"e-?mail|mail|contact|write|reach|kontakt|courriel|correo", re.I),
    re.compile(r"\bip\b|ipv6|address|host|server|login|from|adresse|ping|peer", re.I),
    re.compile(r"card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta|cc\b", re.I),
    re.compile(r"tel|phone|call|fax|mobile|cell|ring|anruf|llam|appel|handy|\bph\b", re.I),
    re.compile(r"iban|account|bank|konto|compte|cuenta|transfer", re.I),
    re.compile(r"ssn|social|national|insurance|dni|nie\b|nif|tax|steuer|passport|sécu|\bid\b", re.I),
    re.compile(r"key|token|secret|passw|pwd|credential|bearer|auth", re.I),
)
AGAINST = re.compile(r"version|\bv\b|isbn|order|part|no\.|nr\.|date|on |page|score|range|ratio|item|invoice|transact|\$|€|£|=|serial|art\.|year|total|commit|sha|digest|checksum|tracking|at ", re.I)


def proposed(text: str, generators: list[int]) -> list[tuple[int, int, int]]:
    spans = set()
    for k in generators:
        kind, pattern = GENERATORS[k]
        for m in pattern.finditer(text):
            start, end = m.span("v" if "v" in pattern.groupindex else 0)
            spans.add((start, kind, end))
            if kind == 0:  # a host's name may end before any of its dots, what follows being the next sentence
                spans.update((start, kind, d.start()) for d in DOT_BEFORE_LABEL.finditer(text, start, end) if AT_LABEL_DOT.search(text, start, d.start()))
    return sorted(spans)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) proposed by the generators; they may overlap."""
    return proposed(text, proposing(text))


def iban(s: str) -> bool:
    """Whether the check digits of an account number hold."""
    s = re.sub("[ -]", "", s).upper()
    return len(s) > 4 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def address(s: str) -> bool:
    """Whether it is an address of eight 16-bit groups, of which :: leaves some out."""
    try:
        return IPv6Address(s).packed != bytes(16)
    except ValueError:
        return False


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format, by its first characters, and context of a candidate: a longer key looks like a long one."""
    s = text[start : min(end, start + FORMAT)]
    d = only_digits(s)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    marks = re.sub("[0-9A-Za-z]", "", s)
    turns = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(s, s[1:], strict=False))
    return [
        kind, len(s), len(d), len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0, len(marks),
        marks.count("."), marks.count("-"), marks.count(" "), marks.count("/"), marks.count("("), marks.count(":"), s.startswith("+"), s.startswith("0"), s.startswith("("),
        float(len(d) >= 12 and luhn(d)), float(len(d) >= 12 and d[0] in "23456"), float(kind == 4 and iban(s)), float(kind == 1 and ":" in s and address(s)), float(kind == 6 and s.startswith(PREFIXES)), float(bool(groups) and len(groups) == 4 and all(byte_part(g) for g in re.findall("[0-9]+", s))),
        float(bool(re.search(r"[@(\[{]|\bat\b", s))), float(bool(re.search(r"[(\[{]\s?(?:at|dot|\.)\s?[)\]}]|@", s, re.I))), float(bool(re.search(r"(?:\.|dot)\W{0,2}(?:com|org|net|edu|de|fr|es|uk|io|info|gov|eu|ch)\b", s, re.I))),
        *(float(bool(h.search(before))) for h in HINTS), float(bool(AGAINST.search(before))),
        float(before[-1:].isalnum()), float(after[:1].isalnum() or after[:1] in "%€$°"), float(bool(re.search("[0-9]$|[0-9][.,:/-]$", before.rstrip()))), float(bool(re.match(r"\s?[.,:/-]?[0-9]", after))),
        float(bool(re.match(r"(?:19|20)[0-9]{2}\b", s)) or bool(re.search(r"\b(?:19|20)[0-9]{2}$", s))),
        turns, len(set(s)), sum(c.isalpha() for c in s), sum(c in "abcdefABCDEF" for c in s), s.count("::"), float(bool(re.search("[A-Z]{2}[0-9]{2}[ -]?$", before))), float(before[-1:] in "\"'"), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(bool(re.match("(?:0|00|\\+)", s)) and 8 <= len(d) <= 15),
    ]


#: What the training texts are written with. TRUE and FALSE: notations of each kind, and what only looks like them;
#: "9" is a digit, "h" a hexadecimal one, "A" and "a" a letter, "*" any of them, "~" a short word, and "\" takes the
#: next as it is. CUES: words that stand before.
TRUE = (
    ["<me><at><host><dot><any>", "<me><at><host><dot><any>", "<me><at><host><dot>~<dot><any>", "<me><at><host>.<any>", "<me>@<host>[.]<any>", "<me> @ <host>.<top>", "<me> @ <host> . <top>", "<me> \\at <host> \\dot <top>", "<me> \\at <host> \\dot ~ \\dot <top>"],
    ["<ip [.]>", "<ip (.)>", "<ip [dot]>", "<ip  dot >", "<ip (dot)>", "<ip  [.] >", "2001:hhhh:hhh::h", "hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh", "fe80::hhhh:hhhh:hhhh:hhhh", "2001:hhh:h:hh:h:h:h:h", "2\\a0h:hhhh:h::hhhh"],
    ["<card .>", "<card />", "<card _>", "<card   >", "<card  - >", "<card . >", "<near  >", "<near -.>", "<near>", "<near->", "<near  - >", "<near/>"],
    ["(999) 999-9999", "999-999-9999", "999.999.9999", "(999) 999 9999", "099 9999 9999", "0999/999 999", "0099 999 999 999", "+99/999/99999", "1-999-999-9999", "09 99 99 99 99", "(099) 999-9999", "0999 9999999", "0099 9 99 99 99 99", "0099 99 9999 9999", "99 999 99 99", "999 99 99 99", "099 / 999 99999", "0999 / 999999", "+99 (0)99 999999", "0099 999 9999999"],
    ["<iban>", "<iban >", "<iban->"],
    ["999-99-9999", "99999999A", "99999999-A", "X9999999A", "Y9999999-A", "AA 99 99 99 B", "AA999999C", "1 99 99 99 999 999 99", "2999999999999"],
    ["hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh", "****************", "********************************", "\\A\\K\\I\\AAA99AA9A9AAA99A9", "ghp_************************************", "sk-********************************", "~99!~9*", "~A9*9a#9"],
)
FALSE = (
    ["~ \\at ~. ~", "~ \\at ~ . ~", "~ \\at ~ \\dot ~", "~ @ ~. ~", "~ \\at <host>.<top>", "~ \\at ~.<top>", "~ \\at <host>.~.<top>"],
    ["<no [.]>", "<no (.)>", "<no  dot >", "99:99:99", "9:99:99", "99:99", "::", "~::~", "h::h::~", "9:9:9", "9:9:9:9", "99:9:99:9", "hh:hh:hh:hh:hh:hh", "hh:hh:hh:hh:hh:hh:hh:hh", "hhhh:hhhh:hhhh"],
    ["999999999999", "9999999999999", "99999999999999", "999999999999999999", "978-9-9999-9999-9", "9789999999999", "1699999999999", "9999 9999 9999 9", "9999/9999/9999/99", "2024-9999-9999-99", "9999999999999999", "9999999999999999", "1699999999999999", "9999 9999 9999 9999", "9999-9999-9999-9999"],
    ["9/29/2019", "2019-12-29", "9.99.999", "1999-2009", "99 999 999", "999.99", "999 999", "9999 9999", "99-9999", "99 99 99 99", "9.9.9", "99/99", "1999 99 99", "99.99.2009", "999 99", "2029-999-9999", "9 999 999", "99 x 99 x 9", "999-999-9999", "999.999.9999", "999-9999-999", "99-999-9999"],
    ["AA99 AAAA AAAA AAAA", "AB12CDEFGHIJKLMNOP", "AA9999999999999999"],
    ["999-99-9999", "99999999A", "99999999-A", "AA 99 99 99 B", "2999999999999", "AA999999C", "99-99-9999"],
    ["~~~~", "~_~_~", "~-~-~", "~.~.~", "/~/~/~", "$~~~", "{~~~}", "~~~~~~", "~ ~ ~", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"],
)
CUES = (
    ["mail me:", "contact", "write to", "Kontakt", "correo"], ["IP", "host", "server", "from", "ping"], ["card", "Visa", "credit card no", "Karte", "tarjeta"], ["call", "tel.", "phone:", "fax", "mobile"],
    ["IBAN", "account", "bank", "Konto"], ["SSN", "social security", "DNI", "NIE", "national insurance"], ["token = \"", "api_key: ", "password=", "secret: \"", "passwd ", "Bearer ", "access token "],
)
AWAY = ["version", "order", "part no.", "part", "ISBN", "on", "page", "range", "total $", "score", "serial", "tracking", "year", "at", "transaction", "ratio", "item", "invoice"]
HASHES = ["commit ", "sha1 ", "checksum ", "digest: ", "revision "]


def written(rng: random.Random) -> tuple[str, tuple[int, int], int, bool]:
    """A text, the span in it, the span's kind and whether it is personal data."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["the", "ra", "on", "le", "mi", "st", "er", "an", "to", "ve", "in"]) for _ in range(rng.randint(1, 4)))

    def special(name: str) -> str:
        kind, sep = re.match("([a-z]+)(.*)", name, re.S).groups()
        if kind == "top":
            return rng.choice(["com", "org", "net", "de", "fr", "es", "io"])
        if kind == "me":
            return word() + rng.choice(["", "", digits(2), *(m + word() for m in "._-+")])
        if kind == "host":
            return word() + rng.choice(["", "", "-" + word(), digits(1)])
        if kind in ("at", "dot"):
            return rng.choice(["{}", " {} ", "{} "]).format(rng.choice(["({})", "[{}]", "{{{}}}"]).format(kind))
        if kind == "any":
            return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 4)))
        if kind in ("ip", "no"):
            parts = [rng.randint(0, rng.choice([9, 99, 255])) for _ in range(4)]
            if kind == "no":
                parts[rng.randrange(4)] = rng.randint(256, 999)
            return (sep[1:] or ".").join(map(str, parts))
        if kind in ("card", "near"):
            body = rng.choice("23456") + digits(14)
            number = next(body + c for c in "0123456789" if luhn(body + c)) if kind == "card" else body + digits(1)
            return (sep[1:] if kind == "card" else sep.strip(".")).join(number[i : i + 4] for i in range(0, 16, 4))
        body, country = rng.choice(["", filled("AAAA"), filled("A")]) + digits(rng.choice([10, 12, 14, 16, 18, 20])), rng.choice(["DE", "FR", "ES", "GB", "IT", "BE", "NL", "AT", "PL"])
        number = country + f"{98 - int(''.join(str(int(c, 36)) for c in body + country) + '00') % 97:02}" + body
        return sep.join(number[i : i + 4] for i in range(0, len(number), 4))

    def filled(form: str) -> str:
        out, at = [], 0
        while at < len(form):
            c, at = form[at], at + 1
            if c == "\\":
                c, at = form[at], at + 1
                out.append(c)
            elif c == "<":
                end = form.index(">", at)
                out.append(special(form[at:end]))
                at = end + 1
            else:
                letters = {"9": "0123456789", "h": "0123456789abcdef", "A": "ABCDEFGHJKLMNPRSTVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz", "*": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
                out.append(word() if c == "~" else rng.choice(letters[c]) if c in letters else c)
        return "".join(out)

    kind, true = rng.randrange(len(KINDS)), rng.random() < 0.5
    form = rng.choice((TRUE if true else FALSE)[kind])
    span = filled(form)
    # what is written alike, or is a card without its check digit, is told apart by what names it
    alike = form in TRUE[kind] and form in FALSE[kind] or kind == 2 and not luhn(only_digits(span))
    cue = rng.random() < (0.6 if true else 0.15 if kind != 5 and not alike else 0) or true and (alike or kind == 5 and rng.random() < 0.8 or kind == 3 and not span.startswith(("(", "+")) and rng.random() < 0.8)
    if kind == 6:  # a key is one by what names it; hashes of other things look alike
        bare = true and span.startswith(("AKIA", "ghp_", "sk-")) and rng.random() < 0.5
        cue = true and not bare or not true and not re.fullmatch("[0-9a-f]+", span)
        lead = rng.choice(CUES[6]) if cue else word() + " " if bare else rng.choice(HASHES)
    else:
        lead = (rng.choice(CUES[kind]) if cue else rng.choice(AWAY) if not true and rng.random() < (0.6 if kind != 5 and not alike else 0.8 if alike else 1) else word()) + " "
    text = f"{' '.join(word() for _ in range(3))} {lead}"
    tail = ('"' if lead.endswith('"') else "") + rng.choice([" ", ". " if kind != 6 else " ", ", " if kind != 6 else "\n"])
    return text + span + f"{tail}{word()} {word()}", (len(text), len(text) + len(span)), kind, true


class Trees:
    """Trees of depth 3 boosted on the logistic loss; splits are looked for at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3, most: int = 24):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, most + 1)[1:-1])) for c in x.T]
        self.trees, f = [], np.zeros(len(y))
        self.start = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
        bins = self._bins(x)
        f += self.start
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(bins, y - p, p * (1 - p), np.arange(len(y)), 3, rate)
            self.trees.append(tree)
            f += self._apply(tree, bins)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def _grow(self, bins, g, h, rows, depth, rate):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = None
        if depth and len(rows) > 20:
            wide = max(map(len, self.edges)) + 1
            places = (bins[rows] + np.arange(bins.shape[1]) * wide).ravel()
            left_g, left_h = (np.bincount(places, np.repeat(x[rows], bins.shape[1]), bins.shape[1] * wide).reshape(-1, wide).cumsum(1)[:, :-1] for x in (g, h))
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            k, cut = np.unravel_index(gain.argmax(), gain.shape)
            best = (int(k), int(cut)) if gain[k, cut] > 1e-6 else None
        if best is None:
            return rate * total_g / (total_h + 1)
        k, cut = best
        low = bins[rows, k] <= cut
        return k, cut, self._grow(bins, g, h, rows[low], depth - 1, rate), self._grow(bins, g, h, rows[~low], depth - 1, rate)

    def _apply(self, tree, bins) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(bins), tree)
        k, cut, low, high = tree
        return np.where(bins[:, k] <= cut, self._apply(low, bins), self._apply(high, bins))

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        return self.start + sum((self._apply(t, bins) for t in self.trees), np.zeros(len(x)))


#: For each kind its trees, and the least score taken.
Model = tuple[tuple[Trees, float], ...]


@cache
def trained(rows: int = 18000, seed: int = 7) -> Model:
    """Trees for the candidates of each kind, and the least score at which held-out precision reaches ``PRECISION``."""
    rng = random.Random(seed)
    x: list[list] = [[] for _ in KINDS]
    y: list[list] = [[] for _ in KINDS]
    while sum(map(len, x)) < rows:
        text, (first, last), kind, true = written(rng)
        for start, k, end in candidates(text):
            x[k].append(describe(text, start, k, end))
            y[k].append(true and k == kind and 10 * (min(end, last) - max(start, first)) >= 9 * max(end - start, last - first))
    out = []
    for rows_of, truth in zip(x, y, strict=True):
        a, b = np.array(rows_of, float), np.array(truth, float)
        held = np.arange(len(a)) % 4 == 0
        trees = Trees(a[~held], b[~held])
        score = trees.score(a[held])
        order = np.argsort(-score, kind="stable")
        precise = b[held][order].cumsum() / np.arange(1, held.sum() + 1)
        good = np.flatnonzero(precise >= PRECISION)
        out.append((trees, max(0.0, float(score[order][good[-1]])) if len(good) else float("inf")))  # never on less than even odds
    return tuple(out)


def scored(text: str, spans: list[tuple[int, int, int]], model: Model) -> np.ndarray:
    """How far each candidate's score lies over its kind's threshold."""
    out, kinds = np.zeros(len(spans)), np.array([s[1] for s in spans])
    for k in np.unique(kinds):
        trees, limit = model[k]
        at = np.flatnonzero(kinds == k)
        out[at] = trees.score(np.array([describe(text, *spans[i]) for i in at], float)) - limit
    return out


def found_spans(text: str, model: Model | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end). Equal scores: the candidate that begins first goes first, then the longer, then the kind listed first."""
    base = base_spans(text)
    more = _apart(candidates(text), base)
    if not more:
        return base, base
    score = scored(text, more, model or trained())
    taken: list[tuple[int, int, int]] = []  # in order, apart from each other
    for i in sorted(np.flatnonzero(score >= 0).tolist(), key=lambda i: (-score[i], more[i][0], -more[i][2], more[i][1])):
        span = more[i]
        at = bisect_left(taken, (span[2],))  # those that begin before its end
        if at == 0 or taken[at - 1][2] <= span[0]:
            taken.insert(bisect_left(taken, span), span)
    return base, sorted(base + taken)


def _apart(spans: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``spans`` that overlap none of ``others``."""
    starts, ends = np.array([o[0] for o in others], int), np.maximum.accumulate(np.array([o[2] for o in others] or [0], int))
    out = []
    for s in spans:
        k = int(np.searchsorted(starts, s[2], side="left"))
        if k == 0 or ends[k - 1] <= s[0]:
            out.append(s)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlaps merged, replaced by its kind in brackets."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", redact: bool = False) -> DataFrame:
    """For each row of ``docs``: its row number, id, the number of base spans of each kind, base_sha256, spans and n_spans (all of them); and redacted_text if asked for.

    Null texts count as empty: no spans. Ids may be null or repeat; an empty table
    gives no rows; other columns are not read. Offsets are code points. Texts of any
    length are searched whole, in time about linear; one text and its candidates are
    held at a time beside their batch. The trees are trained once, on the driver.
    Of added spans that overlap, the higher score stays; equal scores: the one that begins first, then the longer, then the kind
    listed first. Generators propose hosts of five labels, names of 64 and labels of 63 characters at most, and
    what follows a key's name within 64 characters; keys may have any length.
    """
    docs = numbered(docs, F.col(id).alias("id"), F.col(text).alias("text")).select(ROW, "id", "text")
    kind = f"{ROW} long, id {docs.schema['id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_spans long" + ", redacted_text string" * redact
    model = docs.sparkSession.sparkContext.broadcast(trained())  # some hundred small trees

    def rows(columns):
        number, ids, texts = columns
        found = [found_spans(t or "", model.value) for t in texts]
        counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(len(BASE))]
        out = [number, ids, *counts, [sha256(joined(base).encode()).hexdigest() for base, _ in found], [joined(spans) for _, spans in found], [len(spans) for _, spans in found]]
        return out + [[redacted(t or "", spans) for t, (_, spans) in zip(texts, found, strict=True)]] * redact

    return map_rows(docs, kind, rows).withColumnRenamed("id", id)
