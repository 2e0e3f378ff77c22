"""Credentials in commands and configuration, found and replaced (problem 4).

Token formats, key armor, connection strings and named values are grammars of one deterministic
automaton. Strings are scanned in overlapping chunks; spans are absolute, a span seen in two
chunks is one, and the text is rebuilt around placeholders, so everything else stays as it was.
A chunk looks at its middle; the overlap before it settles the automaton's state, the one behind
it gives values room to end. A string of which some chunk does not settle is scanned as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.llm.automaton import ALNUM, DIGITS, Automaton, Grammar, Part, but, chars, many, maybe, one_of, word, words
from corpusgate.session import materialize

#: Characters of a chunk, and of the stretch that it shares with the next one.
CHUNK = 200_000
OVERLAP = 20_000

# Public prefixes of vendor tokens, with the least number of characters after them.
TOKEN_PREFIXES = {
    "ghp_": 30, "gho_": 30, "ghu_": 30, "ghs_": 30, "ghr_": 30, "github_pat_": 22, "glpat-": 16, "npm_": 30, "pypi-": 16,
    "sk_live_": 16, "sk_test_": 16, "rk_live_": 16, "AIza": 30, "xoxb-": 10, "xoxp-": 10, "xoxa-": 10, "xoxr-": 10, "xoxs-": 10,
    "SG.": 20, "hf_": 30, "dop_v1_": 30, "shpat_": 30, "AGE-SECRET-KEY-": 30, "sk-": 32, "hvs.": 20, "dckr_pat_": 20, "whsec_": 20,
}
# Names of values that are secret, in any case; a single - or _ may stand between words.
SECRET_NAMES = (
    "password", "passwd", "passphrase", "passwort", "pwd", "pass", "secret", "token", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key",
    "privatekey", "private_key", "private-key", "accountkey", "account_key", "account-key", "sharedaccesskey", "secretkey", "secret_key", "secret-key",
    "credential", "credentials", "authkey", "auth_key", "auth-key", "_key", "-key", "_pat",
)
# Query parameters that carry a secret by themselves.
SECRET_PARAMETERS = ("sig", "signature", "key", "auth", "code", "token", "secret", "password", "apikey", "api_key", "access_token", "x-amz-signature")
# Texts that stand in for a value.
STAND_INS = ("your", "replace", "change", "example", "dummy", "placeholder", "redacted", "insert", "todo", "none", "null", "true", "false", "undefined", "secret_here", "token_here", "missing")

_SPACE = chars(" \t")
_GAP = many(one_of(_SPACE, word("\\") + maybe(word("\r")) + word("\n")), 1)
_BARE = but(" \t\r\n'\"`;,&|<>(){}\\")
_SQ, _DQ = but("'\n"), but("\"\n\\")
_TOKEN = chars(ALNUM + "_-")
_B64 = chars(ALNUM + "+/=_-")


#: Kinds that are judged by the name before the value, too.
_LOCATED = ("assigned", "named", "said", "option", "configured", "header")


def _prefixed() -> list[Grammar]:
    out = [Grammar("token", word(p), many(chars(ALNUM + "_-."), n), len(p)) for p, n in TOKEN_PREFIXES.items()]
    jwt = many(_TOKEN, 6) + word(".") + many(_TOKEN, 6) + word(".") + many(_TOKEN, 6)
    return [*out, Grammar("token", word("eyJ"), jwt, 3)]


def grammars() -> list[Grammar]:
    """The order decides between matches of one length."""
    name = words(*SECRET_NAMES) + many(chars(DIGITS))
    closed = maybe(chars("'\""))
    sign = many(_SPACE) + chars("=:") + many(_SPACE)
    escaped = maybe(word("\\"))
    bare_start = but(" \t\r\n'\"`;,&|<>(){}\\=:")
    # The end of the armor may be cut off; what is left of the key is taken then.
    armor_end = word("-----END ") + many(chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ")) + word("-----")
    armor = (
        many(chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ")) + word("PRIVATE KEY") + maybe(word(" BLOCK")) + word("-----")
        + many(one_of(chars(ALNUM + "+/= \t\r\n\\:,.()"), word("-") + chars(ALNUM))) + maybe(armor_end)
    )
    option = many(word("-"), 1) + many(chars(ALNUM + "_-")) + name
    command = lambda *parts: sum_of(*parts)
    contexts = [
        ("url_login", word("://") + many(but(" \t\r\n'\"`/:@?#")) + word(":"), many(but(" \t\r\n'\"`/@"), 3) + word("@")),
        ("webhook", words("hooks.slack.", "hooks.", "discord.com/api/webhooks/") + many(but(" \t\r\n'\"`?")) + word("/"), many(chars(ALNUM + "_-"), 20)),
        ("parameter", chars("?&") + words(*SECRET_PARAMETERS) + word("="), many(but(" \t\r\n'\"`&#<>{}$"), 8)),
        ("assigned", name + closed + sign + escaped + word("'"), many(_SQ, 3)),
        ("assigned", name + closed + sign + escaped + word('"'), many(_DQ, 3)),
        ("assigned", name + closed + sign, bare_start + many(_BARE, 2)),
        ("option", option + one_of(_GAP, word("=")) + word("'"), many(_SQ, 3)),
        ("option", option + one_of(_GAP, word("=")) + word('"'), many(_DQ, 3)),
        ("option", option + one_of(_GAP, word("=")), bare_start + many(_BARE, 2)),
        ("named", name + _GAP + chars("'\""), many(but("'\"\n"), 3)),
        ("said", words("token", "password", "secret", "key", "passphrase") + _GAP + words("was", "is") + maybe(word(":")) + _GAP, bare_start + many(_BARE, 7)),
        ("netrc", words("login") + _GAP + many(but(" \t\r\n"), 1) + _GAP + words("password") + _GAP, many(but(" \t\r\n'\"\\"), 3)),
        ("configured", words("secret_access_key", "secretaccesskey", "auth_token", "authtoken", "_password") + _GAP, bare_start + many(_BARE, 7)),
        ("header", words("authorization") + closed + many(_SPACE) + chars(":=") + many(_SPACE) + closed + words("bearer", "basic", "token", "apikey") + many(_SPACE, 1), many(chars(ALNUM + "+/=_-.~"), 6)),
        ("encoded_login", word('"auth') + escaped + word('"') + many(_SPACE) + word(":") + many(_SPACE) + word('"'), many(_B64, 8)),
        ("command", command(words("sshpass"), _GAP, word("-p"), maybe(_GAP), maybe(chars("'\""))), many(but(" \t\r\n'\""), 3)),
        ("command", command(words("docker", "podman", "helm", "oras", "crane"), _GAP, maybe(words("registry", "auth") + _GAP), words("login"), many(one_of(but("|;&\n"), word("\\\n"))), _SPACE, words("-p", any_case=False), _GAP, maybe(chars("'\""))), many(but(" \t\r\n'\"|;&"), 3)),
        ("command", command(words("mysql", "mysqldump", "mysqladmin", "mariadb"), many(one_of(but("|;&\n"), word("\\\n"))), _SPACE, word("-p"), maybe(chars("'\""))), many(but(" \t\r\n'\"|;&"), 3)),
        ("command", command(words("redis-cli"), many(one_of(but("|;&\n"), word("\\\n"))), _SPACE, word("-a"), _GAP, maybe(chars("'\""))), many(but(" \t\r\n'\"|;&"), 3)),
        ("command", command(words("curl", "wget", "http"), many(one_of(but("|;&\n"), word("\\\n"))), _SPACE, words("-u", "--user", any_case=False), one_of(_GAP, word("=")), maybe(chars("'\"")), many(but(" \t\r\n'\":"), 1), word(":")), many(but(" \t\r\n'\"|;&"), 3)),
        ("command", command(words("openssl"), many(one_of(but("|;&\n"), word("\\\n"))), _SPACE, words("-K", "-k", any_case=False), _GAP), many(chars(ALNUM), 8)),
        ("command", command(words("openssl"), many(one_of(but("|;&\n"), word("\\\n")), 1), words("pass:", any_case=False)), many(but(" \t\r\n'\"|;&"), 3)),
        ("piped", words("echo", "printf") + _GAP + maybe(words("-n", "-e", any_case=False) + _GAP) + word("'"), many(_SQ, 3) + _PIPED_END),
        ("piped", words("echo", "printf") + _GAP + maybe(words("-n", "-e", any_case=False) + _GAP) + word('"'), many(_DQ, 3) + _PIPED_END),
    ]
    return [Grammar("private_key", word("-----BEGIN "), armor, 11), *[Grammar(kind, *parts, located=kind in _LOCATED) for kind, *parts in contexts], *_prefixed()]


def sum_of(*parts: Part) -> Part:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


# What follows a secret that is piped into a login; cut off again by ``accepted``.
_PIPED_END = chars("'\"") + maybe(_GAP) + word("|") + many(one_of(but("|;&\n"), word("\\\n"))) + words("--password-stdin", "--with-token", "--stdin", any_case=False)

_REFERENCE = re.compile(
    r"^\$[\w{(]|\$\{|\$\(|\{\{|\}\}|^%\w+%$|^<[^>]*>$|^[*xX•.#_-]+$|^\[[^\]]*\]$|^@|^(?:\./|\.\./|~/|/)[\w./~-]*$|^file:|^env:|^vault:|secrets?\.[A-Z_a-z]|process\.env|os\.environ"
    r"|^[\w./-]+\.(?:pem|key|pub|txt|json|ya?ml|env|crt|cer|toml|cfg|ini|sh)$"
)
_STAND_IN = re.compile(r"(?i)^[<\[({]*(?:" + "|".join(STAND_INS) + r")(?:[\s_.<>\])}-]|$)|_HERE$|^\d{1,6}$|^\$")
_SHORT = ("pass", "pwd", "_key", "-key", "_pat")


def accepted(kind: str, text: str, at: int, start: int, end: int) -> int | None:
    """The value's end if it is usable by itself, else None: no reference, placeholder, path or number."""
    value = text[start:end]
    if kind == "private_key":
        body = re.sub(r"-----[^-]*-----|\\n|\s", "", value)
        return end if len(body) >= 40 else None
    if kind == "piped":
        end = start + re.search(r"['\"][\s\\]*\|[^|]*$", value).start()
        value = text[start:end].removesuffix("\\n")
    elif kind == "url_login":
        end -= 1
        value = value[:-1]
    before = text[at - 1] if at else " "
    if kind == "token":
        if before.isalnum() or before == "_":
            return None
        while value and value[-1] in ".-_" and kind == "token" and not value.startswith("eyJ"):
            value, end = value[:-1], end - 1
    elif kind in ("assigned", "named", "said"):
        key = text[at:start].lower()
        if key.startswith(("pass", "pwd")) and not key.startswith(("password", "passwd", "passphrase", "passwort")) and before.isalpha() and (before.islower() == text[at].islower()):
            return None
        # A pattern of an edit command, a default of a shell variable, or armor, which has a grammar of its own.
        if value.startswith((".*/", "^", "-----BEGIN")) or (text[start - 1] == ":" and value[0] in "?-+="):
            return None
        if kind == "assigned" and value.endswith("/") and text[end : end + 1] in "'\"":
            value, end = value.rstrip("/"), start + len(value.rstrip("/"))
        if key.startswith(("_key", "-key", "_pat")) and not _looks_random(value):
            return None
        if kind == "assigned" and text[start - 1 : start] == " " and ":" in text[at:start] and len(value) < 6:
            return None
        if kind == "said" and not _looks_random(value):
            return None
    elif kind in ("option", "configured"):
        if re.search(r"(?i)-key$", text[at:start].rstrip(" ='\"\\\n\t")) and not _looks_random(value):
            return None
    if not value.strip() or _STAND_IN.search(value):
        return None
    # Base64 may begin like a path, but no path mixes all kinds of characters at such a length.
    if _REFERENCE.search(value) and not (value[0] == "/" and len(value) >= 24 and "." not in value and _looks_random(value, 3)):
        return None
    if kind == "header" and not _looks_random(value) and not re.search(r"(?i)basic\s", text[at:start]):
        return None
    return end


def _looks_random(value: str, least: int = 2) -> bool:
    """Eight or more characters of at least ``least`` kinds, as in generated keys."""
    kinds = (any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value))
    return len(value) >= 8 and sum(kinds) >= least


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton(grammars())


def spans_of(text: str, machine: Automaton | None = None, own: tuple[int, int] | None = None, head_open: bool = False, tail_open: bool = False) -> list[tuple[str, int, int]] | None:
    """``kind, start, end`` of every credential in one text, by start; what lies inside another one is part of it.

    For a piece of a text, ``own`` and the open ends are those of ``Automaton.found``; None if the
    piece alone does not tell.
    """
    found = []
    for f in (machine or automaton()).found(text, accepted, own, head_open, tail_open):
        if f is None:
            return None
        found.append(f)
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if not out or b > out[-1][2]:
            out.append((kind, a, b))
    return out


def chunked(strings: DataFrame, keys: list[str], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keys, __from, __piece, __low, __high, __last``: pieces of ``chunk`` characters that share ``overlap`` with the next one.

    A piece's own places, those from ``__low`` to ``__high``, end in the middle of the overlaps;
    every place of the string is one piece's own.
    """
    step, half = chunk - overlap, overlap // 2
    length = F.length("__text")
    starts = F.when(length <= chunk, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(length - F.lit(overlap) - 1, F.lit(0)), F.lit(step)))
    pieces = strings.select(*keys, F.col(text).alias("__text")).select("*", F.explode(starts).alias("__from"))
    last = F.col("__from") + chunk >= length
    return pieces.select(
        *keys, "__from", F.substring("__text", F.col("__from") + 1, F.lit(chunk)).alias("__piece"), F.when(F.col("__from") == 0, 0).otherwise(half).alias("__low"),
        F.when(last, chunk + 1).otherwise(half + step).alias("__high"), last.alias("__last"),
    )


def credential_spans(strings: DataFrame, keys: list[str], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keys, kind, start, end`` (characters from 0) of every credential of ``text``, once each.

    ``keys`` identify a string; rows repeated in keys and text count once. Null and empty strings
    have none, and rows with a null key are left out. Columns other than keys and text are ignored.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in strings.select(*keys).schema) + ", kind string, start int, end int"
    spark = strings.sparkSession
    machine = spark.sparkContext.broadcast(automaton())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from corpusgate.llm.credentials import spans_of

        for pdf in batches:
            rows = []
            for *key, at, piece, low, high, last in pdf.itertuples(index=False, name=None):
                spans = spans_of(piece, machine.value, (low, high), at > 0, not last)
                rows += [(*key, None, -1, -1)] if spans is None else [(*key, kind, at + a, at + b) for kind, a, b in spans]
            yield pd.DataFrame(rows, columns=[*keys, "kind", "start", "end"])

    some = strings.where(F.length(text) > 0).dropna(subset=keys).select(*keys, text)
    found = materialize(chunked(some, keys, text, chunk, overlap).mapInPandas(scan, schema).distinct(), "spans")
    # Strings of more than one chunk only: those with a piece that did not tell are scanned whole.
    longer = some.where(F.length(text) > chunk)
    again = longer.join(found.where("kind IS NULL").select(*keys).distinct(), keys, "left_semi")
    whole = again.select(*keys, F.lit(0).alias("__from"), F.col(text).alias("__piece"), F.lit(0).alias("__low"), (F.length(text) + 1).alias("__high"), F.lit(True).alias("__last")).mapInPandas(scan, schema)
    spans = found.where("kind IS NOT NULL").unionByName(whole).distinct()
    # A span inside another one of its string is part of it; chunks overlap, so both may be seen.
    reach = F.max("end").over(Window.partitionBy(*keys).orderBy("start", F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("__reach", F.coalesce(reach, F.lit(-1))).where(F.col("end") > F.col("__reach")).drop("__reach")


def spliced(text: Column, spans: Column) -> Column:
    """``text`` with each of ``spans`` (array of start, end, kind by rising start and end) replaced by ``<KIND>``; null spans change nothing."""
    ended = lambda i: F.coalesce(F.get(spans, i)["end"], F.lit(0))
    pieces = F.transform(
        spans,
        lambda s, i: F.concat(F.substring(text, ended(i - 1) + 1, F.greatest(s["start"] - ended(i - 1), F.lit(0))), F.lit("<"), F.upper(s["kind"]), F.lit(">")),
    )
    rest = F.substring(text, ended(F.size(spans) - 1) + 1, F.length(text))
    return F.when(spans.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest))


def redacted(strings: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, text, n_credentials``: each string with placeholders for its credentials; null stays null.

    Rows repeated in keys and text give one row; rows with a null key are left out.
    """
    once = strings.dropna(subset=keys).select(*keys, text).distinct()
    per_string = credential_spans(once, keys, text).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("__spans"))
    return once.join(per_string, keys, "left").select(
        *keys, spliced(F.col(text), F.col("__spans")).alias(text), F.coalesce(F.size("__spans"), F.lit(0)).cast("long").alias("n_credentials")
    )


KEYS = ["source_table", "row_id", "field_name", "pos"]


def command_strings(macros: DataFrame, gates: DataFrame) -> DataFrame:
    """``source_table, row_id, field_name, pos, text``: every step of macros, gate and run of tooling_gates; no null strings or ids."""
    steps = macros.where("macro_id IS NOT NULL").select(F.lit("macros").alias("source_table"), F.col("macro_id").alias("row_id"), F.lit("steps").alias("field_name"), F.posexplode("steps").alias("pos", "text"))
    out = steps
    for field in ("gate", "run"):
        out = out.unionByName(gates.where("gate_id IS NOT NULL").select(F.lit("tooling_gates").alias("source_table"), F.col("gate_id").alias("row_id"), F.lit(field).alias("field_name"), F.lit(0).alias("pos"), F.col(field).alias("text")))
    return out.where("text IS NOT NULL")


def credential_strings(macros: DataFrame, gates: DataFrame) -> DataFrame:
    """``source_table, row_id, field_name, pos`` of each string that itself holds a usable credential."""
    return credential_spans(command_strings(macros, gates), KEYS, "text").select(*KEYS).distinct()
