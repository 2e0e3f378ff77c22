"""Possible personal information in one text: mentions with their places and contexts.

All are only candidates here: each carries the keys of its instance and of the lexical patterns
around it, and whether its own form already makes it a seed. What they are is decided over the
whole corpus.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŴŶŸŹŻŽ"
# Titles before a family name.
TITLES = frozenset("mr mrs ms miss dr prof herr frau mme mlle monsieur madame sr sra señor señora don doña signor signora hr fr".split())
# Words that open sentences or noun phrases and are no given names.
OPENERS = frozenset(
    "the a an this that these those our its his her their my your each every any all no some is are was were do does did if when while with without under over on in at by for from and or but"
    " as of to not please we they it there der die das den dem des ein eine el la los las un una le les une des du il lo gli che see use ask write ticket attn cc re fwd".split()
)
# Words after which two lower-case words may be a name.
ADDRESSED = "thanks|thank you|thx|kudos|danke|merci|gracias|hi|hey|hello|dear|ping|cc|ask|says"
# Words that name the kind of the number after them.
ID_WORDS = (
    r"ssn|social security(?: no\.?| number| nr\.?)?|sin|passport(?: no\.?| number| nr\.?)?|reisepass|pasaporte|passeport|dni|nie|nif|nino|nir|cpf|cnpj|curp|"
    r"steuer-?id(?:nr\.?)?|idnr\.?|steuernummer|tax id|tax number|tin|national id|national insurance(?: no\.?| number)?|personalausweis|ausweis(?:nr\.?)?|id card|"
    r"driv(?:er'?s|ing|er) licen[cs]e(?: no\.?| number)?|licen[cs]e no\.?|permis de conduire|führerschein"
)
PHONE_WORDS = r"tel\.?|telephone|phone|mobile|cell|call|fax|desk|ring|telefon|handy|móvil|teléfono|llámame al|portable|reach (?:me|them|him|her) (?:under|via|at|on)"
MACHINE_WORDS = r"epoch|size|build|id|port|listen on|version|checksum|sha\d*|window|lines?|ticket|pid|offset|bytes|range|commit|ts|rank|day|count"


class Mention(NamedTuple):
    kind: str
    start: int
    end: int
    seed: str | None
    instances: tuple[str, ...]
    patterns: tuple[str, ...]


# Signs of an address, as they are or spelled out; the word alone only where a spelled-out dot follows.
_AT = re.compile(r"(?i)@|[ \t]*[(\[{][ \t]*(?:at|arroba|ät)[ \t]*[)\]}][ \t]*|[ \t]+at[ \t]+(?=[\w-]+(?:[ \t]+dot[ \t]|[ \t]*[(\[]dot))")
_DOT = r"(?:\.|[ \t]*[(\[{][ \t]*(?:dot|punkt|punto|point)[ \t]*[)\]}][ \t]*|[ \t]+(?:dot|punkt)[ \t]+)"
_USER = re.compile(r"(?<![\w.+/-])[A-Za-z0-9_][\w.+-]*\Z")
_HOST = re.compile(rf"(?i)[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[a-z]{{2,}}\b")
_AT_FAST = re.compile(r"@|[(\[{][ \t]*(?:[aA][tT]|arroba|ät)[ \t]*[)\]}]")
_AT_WORD = re.compile(r"(?<=\w)[ \t]+(?:at|AT)[ \t]+(?=[\w-]+[ \t]*(?:[ \t]|[(\[])(?:dot|DOT))")
_DOT_WORD = re.compile(r"(?:dot|DOT)\b")
# Accounts of machines.
MACHINE_USERS = frozenset("git root svn hg deploy www-data nobody ubuntu ec2-user runner oauth2".split())

_NAMEY = rf"[{_UP}][\w’'-]*"
_TYPE = "Street|St\\.?|Avenue|Ave\\.?|Road|Rd\\.?|Lane|Ln\\.?|Drive|Dr\\.?|Court|Ct\\.?|Close|Terrace|Blvd\\.?|Boulevard|Way|Place|Square|Crescent|Parkway|Pkwy|Row|Gardens|Grove|Mews|Hill|Circle|Highway|Trail|Alley"
_OF = "(?:de la|de los|de las|de l’|de l'|des|del|du|de|d’|d')"
# A house number, then the street; or the street, and the house number behind it.
_NUMBER_FIRST = re.compile(
    rf"\d{{1,5}}[a-zA-Z]?\s+(?:{_NAMEY}\s+){{1,3}}(?:{_TYPE})(?!\w)"
    rf"|\d{{1,5}}(?:\s*(?:bis|ter|quater))?,?\s+(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Ii]mpasse|[Pp]lace|[Cc]hemin|[Aa]llée|[Qq]uai|[Rr]oute|[Cc]ours|[Ss]quare|[Pp]assage)\s+(?:{_OF}\s*)?{_NAMEY}"
)
_STREET_FIRST = re.compile(
    rf"(?<![\w./:-])(?:{_NAMEY}[ -])?{_NAMEY}(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|pfad)\s+\Z"
    rf"|(?<![\w./:-])(?:{_NAMEY}[ -])?(?:Straße|Strasse|Weg|Gasse|Allee|Platz)\s+\Z"
    rf"|(?<![\w./:-])(?:Calle|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Carrera|Ronda|Travesía|C/)\s*(?:{_OF}\s+)?{_NAMEY}(?:\s+{_NAMEY})?,?\s+(?:n[.º°o]+\s*)?\Z"
)
_FLAT = re.compile(r"(?:Flat|Apt\.?|Unit|Suite)\s+\w+,\s*\Z")
_ADDRESS_TAIL = re.compile(
    rf"(?:,\s*(?:Apt\.?|Flat|Unit|Suite|#)\s*\w+)?(?:,?\s*\d{{1,2}}\s?º\s?\w)?(?:,\s*\d{{4,5}}\s+{_NAMEY}|,\s*{_NAMEY}(?:,\s*[A-Z]{{2}}\s+\d{{5}}(?:-\d{{4}})?|\s+[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s+\d[A-Z]{{2}})?)?"
)
_DIGITS = re.compile(r"\d[\d ().\-/]*")
#: Digits of the longest single number; a longer run is several numbers.
_MOST_DIGITS = 20
_UNBROKEN = re.compile(r"\d+")
_BETWEEN_NUMBERS = re.compile(r" +(?=\d{21})|(?<=\d{21}) +| +/ *| */ +|(?<=\d{3})/(?=\d{3,}[ -])| {2,}| +- +| +(?=\(?(?:\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4})(?!\d))")
_BEFORE_NUMBER = re.compile(r"(?:(?<![A-Za-z-])(?:[A-Z]{1,3}-?|(?!ID|NR|NO)[A-Z]{2} ))?\(?\+?\(?\Z")
_AFTER_NUMBER = re.compile(r"(?:[ -]?[A-Z](?![A-Za-z0-9]))?(?:\s?(?:ext\.?|x)\s?\d+)?")
_ID_WORD = re.compile(rf"(?i)(?<!\w)(?:{ID_WORDS})\s*(?:[:#=]|is)?\s*\Z")
_RUN = re.compile(rf"(?<![\w./`$@<>-]){_NAMEY}(?:(?:[ \t]+|\.[ \t]*|,[ \t]+){_NAMEY})+(?![/`(]|\.\w|::)")
_PIECE = re.compile(_NAMEY)
_LOWER = re.compile(rf"(?i)(?<![\w])(?:{ADDRESSED})[ ,:]+([^\W\d_][\w’'-]+) ([^\W\d_][\w’'-]+)(?![\w/.@])")
_KNOWN_WORD = re.compile(rf"(?i)(?:^|[^\w])(?P<phone>{PHONE_WORDS})\W{{0,3}}$|(?:^|[^\w])(?P<machine>{MACHINE_WORDS})\W{{0,3}}$")
# Numbers that their form alone tells: British and French social security, American social security.
_ID_FORM = re.compile(r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[12] \d\d (?:0[1-9]|1[0-2]) \d[\dAB] \d{3} \d{3}(?: \d\d)?|(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}")
#: What stands between a name and its own number.
_BESIDE = re.compile(r"(?i)(?=[^|(\"#<]*[|(\"#<])[\"'\s|(#,;:<>-]{1,8}(?:(?:call|tel|phone|mobile|mob|cell|fax)\W{0,3})?\(?")
_DATE = re.compile(r"^(?:\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4})")
_NEWLINE = re.compile("\n")


def folded(word: str) -> str:
    """Lower case without accents, as in the local part of an e-mail address."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower().replace("ł", "l").replace("ø", "o")) if not unicodedata.combining(c))


def _token(word: str) -> str:
    if "@" in word:
        return "MAIL"
    if word[:1] == "`":
        return "CODE"
    if "/" in word:
        return "PATH"
    return re.sub(r"\d+", "#", word)[:24].lower()


def _context(text: str, start: int, end: int) -> tuple[str, ...]:
    """The patterns around a mention: two words before, two after, and one of each side."""
    left = text[max(0, text.rfind("\n", 0, start) + 1, start - 60) : start]
    stop = text.find("\n", end, end + 60)
    right = text[end : stop if stop >= 0 else end + 60]
    before = [_token(w) for w in left.split()[-2:]]
    after = [_token(w) for w in right.split()[:2]]
    if right and not right[0].isspace() and after:
        after[0] = "_" + after[0]
    if left and not left[-1].isspace() and before:
        before[-1] += "_"
    l2, r2 = " ".join(before) or "^", " ".join(after) or "$"
    return (f"L {l2}", f"R {r2}", f"B {before[-1] if before else '^'} | {after[0] if after else '$'}")


def _shape(value: str) -> str:
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", re.sub(r"\s?(?:ext\.?|x)\s?\d+$", " ext", value, flags=re.I))).strip()


class Text:
    """Line numbers of a text's characters."""

    def __init__(self, text: str) -> None:
        self.breaks = [m.start() for m in _NEWLINE.finditer(text)]

    def line(self, place: int) -> int:
        return bisect_right(self.breaks, place - 1) + 1


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether nothing of ``taken``, which is in order and does not overlap, reaches into the span."""
    i = bisect_left(taken, (b,))
    return i == 0 or taken[i - 1][1] <= a


def emails_in(text: str) -> list[tuple[int, int]]:
    out = []
    signs = [*_AT_FAST.finditer(text)]
    if _DOT_WORD.search(text):
        signs = sorted([*signs, *_AT_WORD.finditer(text)], key=re.Match.start)
    for m in signs:
        begin = m.start()
        while begin and text[begin - 1] in " \t" and text[m.start()] != "@":
            begin -= 1
        at = _AT.match(text, begin)
        user = _USER.search(text, max(0, begin - 64), begin)
        host = _HOST.match(text, at.end()) if at and user else None
        if not host or (out and user.start() < out[-1][1]):
            continue
        if user.group().lower() in MACHINE_USERS or re.search(r"://[^\s/]*\Z", text[max(0, user.start() - 80) : user.start()]):
            continue
        out.append((user.start(), host.end()))
    return out


def mentions_in(text: str | None) -> list[Mention]:
    """Every mention of one text; names and numbers as candidates."""
    if not text:
        return []
    out: list[Mention] = []
    mails = emails_in(text)
    out += [_email(text, a, b) for a, b in mails]
    taken = list(mails)
    _numbers(text, out, taken)
    _names(text, out, taken, mails)
    return out


_HOST_DOTS = re.compile(rf"(?i){_DOT}")
_SPELLED_AT = re.compile(r"(?i)[ \t]*[(\[{][ \t]*(?:at|arroba|ät)[ \t]*[)\]}][ \t]*|[ \t]+at[ \t]+")


def _email(text: str, a: int, b: int) -> Mention:
    """A seed if it has its sign; spelled out, it is known by its host and its surroundings."""
    value = text[a:b]
    plain = "@" in value
    host = value.split("@", 1)[1] if plain else _SPELLED_AT.split(value, maxsplit=1)[-1]
    return Mention("email", a, b, "email" if plain else None, (f"H {_HOST_DOTS.sub('.', host).lower()}",), _context(text, a, b))


def _address(text: str, a: int, b: int) -> Mention:
    """A seed if a flat or a town stands beside street and number; else it is known by the street's words and its surroundings."""
    value = text[a:b]
    street = value.split(",")[0] if not value[:1].isdigit() else value
    words = [w.lower() for w in re.findall(r"[^\W\d]{3,}", street.split(",")[0])]
    keys = tuple(f"W {w}" for w in dict.fromkeys(words)) or ("W",)
    return Mention("address", a, b, "address" if "," in value[4:] else None, keys, _context(text, a, b))


def _address_at(text: str, place: int, digits: int) -> tuple[int, int] | None:
    """The address whose house number stands at ``place``, if one does."""
    if digits > 5 or (place and (text[place - 1].isalnum() or text[place - 1] in "./:-_")):
        return None
    m = _NUMBER_FIRST.match(text, place)
    if m:
        flat = _FLAT.search(text, max(0, place - 24), place)
        return flat.start() if flat else place, _ADDRESS_TAIL.match(text, m.end()).end()
    if place > 4 and text[place - 1].isspace() and (text[place - 2].isalpha() or text[place - 2] in ".,º°"):
        street = _STREET_FIRST.search(text, max(0, place - 60), place)
        end = place + digits
        if street and not text[end : end + 1].isalnum() and not text.startswith(("%", " %"), end):
            return street.start(), _ADDRESS_TAIL.match(text, end).end()
    return None


def _digits(run: str) -> int:
    return sum(c.isdigit() for c in run)


def _number_runs(text: str) -> Iterator[tuple[int, str, bool]]:
    """``place, run, further``: runs of digits; one of too many digits as its single numbers, ``further`` behind the first.

    Numbers that only single blanks part stay together.
    """
    for m in _DIGITS.finditer(text):
        if _digits(m.group()) <= _MOST_DIGITS:
            yield m.start(), m.group(), False
            continue
        cuts = [*_BETWEEN_NUMBERS.finditer(text, m.start(), m.end())]
        pieces = list(zip([m.start(), *[c.end() for c in cuts]], [*[c.start() for c in cuts], m.end()]))
        further = False
        for a, b in pieces:
            place = re.compile(r"[^\d]*").match(text, a, b).end()
            if place < b:
                yield place, text[place:b], further
                further = True


def _numbers(text: str, out: list[Mention], taken: list[tuple[int, int]]) -> None:
    upto, before = 0, None
    for place, run, further in _number_runs(text):
        before = before if further else None
        if place < upto:
            continue
        first = len(run) - len(run.lstrip("0123456789"))
        address = _address_at(text, place, first)
        if address:
            if _free(taken, *address):
                out.append(_address(text, *address))
                insort(taken, address)
            upto = address[1]
            continue
        a = _BEFORE_NUMBER.search(text, max(0, place - 8), place).start()
        if _digits(run) < (6 if text[a].isalpha() else 7):
            continue
        b = place + len(run.rstrip(" ().-/"))
        b = _AFTER_NUMBER.match(text, b).end()
        value = text[a:b]
        # Unbroken digits beyond that are neither a phone nor an id number.
        if max(map(len, _UNBROKEN.findall(run))) > _MOST_DIGITS or not _free(taken, a, b) or (a and (text[a - 1].isalnum() or text[a - 1] in (".@_-" if further else ".@/_-"))) or (b < len(text) and (text[b].isalnum() or text[b] in "@_")):
            continue
        while value.startswith("(") and value.count("(") > value.count(")"):
            value, a = value[1:], a + 1
        left = text[max(0, text.rfind("\n", 0, a) + 1, a - 40) : a]
        known, word = _KNOWN_WORD.search(left), _ID_WORD.search(left)
        if word:
            seed, a = "id_number", a - len(left) + word.start()
        elif value.startswith("+") or (known and known.group("phone")):
            seed = "phone"
        elif _DATE.match(value) or (known and known.group("machine")):
            seed = "other"
        elif _ID_FORM.fullmatch(value):
            seed = "id_number"
        else:
            # What the word before the first number of a run says holds for the others.
            seed = before
        before = seed if seed in ("phone", "id_number") else before
        out.append(Mention("number", a, b, seed, (f"S {_shape(value)}",), _context(text, a, b)))
        insort(taken, (a, b))
        upto = b


def _names(text: str, out: list[Mention], taken: list[tuple[int, int]], mails: list[tuple[int, int]]) -> None:
    own = [m.start for m in out if m.kind == "number" and m.seed in ("phone", "id_number")]

    def add(a: int, b: int, given: str | None, family: str, seed: str | None) -> None:
        if not _free(taken, a, b):
            return
        if seed is None and given and not text[a:b].isupper() and (i := bisect_left(own, b)) < len(own) and own[i] < b + 24 and _BESIDE.fullmatch(text, b, own[i]):
            seed = "name"
        if seed is None and given:
            # The address that follows on the same line has the name's letters.
            for x, y in mails[bisect_left(mails, (b,)) :]:
                if x >= b + 40:
                    break
                if "\n" not in text[b:x]:
                    local = folded(re.split(r"@|[(\[{\s]", text[x:y])[0])
                    f = folded(family).split("-")[0]
                    if folded(given) in local or f in local:
                        seed = "name"
        keys = (*((f"G {given.lower()}",) if given else ()), f"F {family.lower()}")
        out.append(Mention("name", a, b, seed, keys, _context(text, a, b)))

    for run in _RUN.finditer(text):
        pieces = [(p.start() + run.start(), p.end() + run.start(), p.group()) for p in _PIECE.finditer(run.group())]
        i = 0
        while i + 1 < len(pieces):
            a, b, first = pieces[i]
            c, d, second = pieces[i + 1]
            between = text[b:c]
            low = first.lower()
            if low in TITLES:
                if i + 2 < len(pieces) and not text[d : pieces[i + 2][0]].strip():
                    add(a, pieces[i + 2][1], second, pieces[i + 2][2], "name")
                    i += 3
                    continue
                if len(second) > 2 and not between.strip(" ."):
                    add(a, d, None, second, "name")
                    i += 2
                    continue
            # The word is no part of the name.
            if low == "attn" and between.strip() in (".", ":", "") and i + 2 < len(pieces) and len(second) > 1 and not text[d : pieces[i + 2][0]].strip():
                add(c, pieces[i + 2][1], second, pieces[i + 2][2], "name")
                i += 3
                continue
            if len(first) == 1 and between.strip() in (".", "") and len(second) > 2 and between:
                if between.strip() == ".":
                    add(a, d, None, second, None)
                i += 1
                continue
            if len(first) < 2 or low in OPENERS:
                i += 1
                continue
            # A middle initial stands between given and family name.
            if len(second) == 1 and not between.strip() and i + 2 < len(pieces) and text[d : pieces[i + 2][0]].strip() in (".", "") and len(pieces[i + 2][2]) > 2:
                add(a, pieces[i + 2][1], first, pieces[i + 2][2], None)
            elif len(second) > 1 and not between.strip():
                add(a, d, first, second, None)
            elif len(second) > 1 and between.strip() == ",":
                add(a, d, second, first, None)
            i += 1
    for m in _LOWER.finditer(text):
        if m.group(1).islower() and m.group(2).islower():
            add(m.start(1), m.end(2), m.group(1), m.group(2), None)
