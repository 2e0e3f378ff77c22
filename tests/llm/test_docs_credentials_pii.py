import random
import time

import pytest

from corpusgate.llm import credentials as C
from corpusgate.llm import docpairs, pii
from corpusgate.llm import pii_mentions as M
from corpusgate.llm import sourcecode as S

PY = '''import x


class Base:
    def run(self, a):
        """Runs the whole pipeline over every stored table once."""

    def stop(self):
        """TODO"""


class Mid(Base):
    pass


class Leaf(Mid):
    @deco
    def run(self, a):
        """@inheritDoc"""

        def inner():
            """Collects pending rows before their window has closed again."""

    def stop(self):
        return 1


def f():
    f"""Not a docstring at all but a long formatted string."""
'''
GO = """// Package a does.
package a

// DoWork sends queued records towards their owners after midnight.
//
//nolint:funlen
func DoWork() {
}

// DoOther sends queued records towards their owners after midnight.

func DoOther() {}

// x := call(y)
func (t *T[K]) Code() { g := func() {} }

// Deprecated: use DoWork because this older form loses records.
func Old() {}

var s = `
// Fake documents something that stands inside a raw string literal.
func Fake() {}
`
"""
TS = """export class Panel {
  /** Renders stored rows into visible cells without blocking anything. */
  // eslint-disable-next-line no-console
  private draw(a: string): void { if (a) { f("}"); } }

  // TODO
  static wipe() {}
}

/**
 * Loads remote settings before starting background workers again.
 * @param x thing
 */
export const load = async (x: number): Promise<string | null> => {
  /* function notReal() {} */
  return `}`;
};

// Too far away, although plainly documenting something quite useful.


function far() {}
"""


def files(spark):
    rows = [("a.py", PY), ("a.go", GO), ("a.ts", TS), ("a.md", PY), ("n.py", None), ("e.go", ""), ("bad.py", "def g(:\n  '''Says quite enough about broken code here anyway.'''"), ("a.go", GO)]
    return spark.createDataFrame([(*r, "x") for r in rows], "rel string, content string, repo string")


def test_documented_symbols(spark):
    got = {tuple(r) for r in docpairs.documented_symbols(files(spark)).collect()}
    # Leaf.run in line 18 says what Base.run says, two classes above.
    assert got == {("a.py", "run", 5), ("a.py", "run", 18), ("a.py", "inner", 21), ("a.go", "DoWork", 7), ("a.ts", "draw", 4), ("a.ts", "load", 14)}


def test_inherited_documentation_climbs_the_hierarchy(spark):
    df = spark.createDataFrame([("a.py", PY)], "rel string, content string")
    got = {(r.symbol_name, r.line_number): r.inherited_from for r in docpairs.documented_pairs(df).collect()}
    assert got == {("run", 5): None, ("run", 18): "Base", ("inner", 21): None}
    circle = spark.createDataFrame([("c.py", "class A(B):\n    def m(self): ...\nclass B(A):\n    def m(self): ...\n")], "rel string, content string")
    assert docpairs.documented_pairs(circle).count() == 0


def test_inheritance_over_all_classes_and_files(spark):
    told = '    """%s queued records towards their owners after midnight."""\n'
    base = "class Base:\n  def run(self):\n" + told
    ts = """export interface Job {
  /** Starts stored work again without blocking other callers. */
  start(): void;
}
export abstract class Shape {
  /** Measures visible borders between neighbouring painted cells. */
  abstract size(): number; 
}
"""
    go = """package a

type Core interface {
	// Flush writes buffered rows towards their owners after midnight.
	Flush()
}

type T struct {
	Core
	n int
}

func (t *T) Flush() {}
"""
    rows = [
        ("a.py", PY, "r"), ("p/one.py", base % "Sends", "r"), ("q/two.py", base % "Drops", "r"), ("q/leaf.py", "class L(Base):\n  def run(self): ...", "r"),
        ("z/leaf.py", "class M(Base):\n  def run(self): ...", "r"), ("z/imp.py", "from p.one import Base as B\nclass N(B):\n  def run(self): ...", "r"),
        ("t/job.ts", ts, "r"), ("t/use.ts", "import { Job } from './job';\nclass A extends Shape implements Job {\n  start() { }\n  size() { return 1 }\n}", "r"), ("g/a.go", go, "r"),
    ]
    df = spark.createDataFrame(rows, "rel string, content string, repo string")
    got = {(r.rel, r.symbol_name, r.inherited_from, r.documentation.split()[0]) for r in docpairs.documented_pairs(df).collect() if r.inherited_from}
    # z/leaf.py does not say which of three classes it means.
    assert got == {
        ("a.py", "run", "Base", "Runs"), ("q/leaf.py", "run", "Base", "Drops"), ("z/imp.py", "run", "Base", "Sends"),
        ("t/use.ts", "start", "Job", "Starts"), ("t/use.ts", "size", "Shape", "Measures"), ("g/a.go", "Flush", "Core", "Flush"),
    }


def test_bases_that_nothing_tells_are_listed_and_deep_or_broken_files_resolved(spark):
    told = '    """Sends queued records towards their owners after midnight."""\n'
    deep = "class C0:\n  def run(self):\n" + told + "".join(f"class C{i}(C{i - 1}): pass\n" for i in range(1, 9)) + "class Last(C8):\n  def run(self): ...\n"
    broken = "class Top:\n  def run(self):\n" + told + "class Low(Top):\n  def run(self):\n    return 1\nx = (\n"
    rows = [("d/deep.py", deep), ("e/broken.py", broken), ("f/one.py", "class Same: pass"), ("g/two.py", "class Same: pass"), ("h/use.py", "class U(Same): pass\nclass V(Missing): pass")]
    df = spark.createDataFrame(rows, "rel string, content string")
    assert {tuple(r) for r in docpairs.unknown_bases(df).collect()} == {("h/use.py", "U", "Same"), ("h/use.py", "V", "Missing")}
    got = {(r.rel, r.inherited_from) for r in docpairs.documented_pairs(df).collect() if r.inherited_from}
    assert got == {("d/deep.py", "C0"), ("e/broken.py", "Top")}


@pytest.mark.parametrize("doc,name", [("", "f"), ("TODO", "f"), ("// go:noinline", "f"), ("Index import.", "indexImport"), ("/** ... */", "f"), ("@param a the one thing that really counts here", "f"), ("row = call(x)\n}", "f"), ("This function does it.", "doIt"), ("see above", "f")])
def test_trivial_documentation(doc, name):
    assert S.is_trivial(doc, name)


def joined(*parts):
    return "".join(parts)


# Written in pieces, so that no scanner of this repository takes them for real ones.
SECRETS = [
    (f"export NPM_TOKEN={joined('npm', '_')}{'aB3' * 12} && npm publish", "aB3aB3"), ("psql postgres://app:Zebra99pool@db.test:5432/x -c 'select 1'", "Zebra99pool"),
    ('aws configure set aws_secret_access_key /Cawx4Nv74lF8x7WAWPg9ak/adXGukb3ce0r6A8', "/Cawx4Nv74"), ("mysql -uapp -pHn8quick -h db.test < s.sql", "Hn8quick"),
    ("echo 'Lm_77drift' | docker login r.test -u bot \\\n  --password-stdin", "Lm_77drift"), ("curl -u bot:Qw12erty https://x.test", "Qw12erty"), ("setx DB_PASSWORD \"aa bb12\" /M", "aa bb12"),
    ('{"auths":{"r.test":{"auth":"Ym90OnNlY3JldA=="}}}', "Ym90OnNlY3JldA=="), ("curl -H 'Authorization: Basic Ym90OnNlY3JldA==' https://x", "Ym90OnNlY3JldA=="),
    (joined("-----BEGIN ", "PRIVATE KEY-----\n", "QUJD" * 20, "\n-----END ", "PRIVATE KEY-----"), "QUJDQUJD"), ("wget 'https://x.test/p?sig=abcDEF123456&ref=a'", "abcDEF123456"),
    ('sed -i "s/^DB_PASSWORD=.*/DB_PASSWORD=Tun62%/" .env', "Tun62%"), ("machine a.test login bob password Zz9_top\\n", "Zz9_top"), ("check # old token was " + "0a1b2c3d" * 5, "0a1b2c3d0a"),
]
HARMLESS = [
    'export API_TOKEN="${DEPLOY_KEY:?missing}"', "login --password '{{.password}}'", "deploy --password-file ./a.txt --token-ttl 3", "token-count --max-tokens 19 --key-width 14 src",
    "setup --api-key <your-api-key> --region eu", "export X_TOKEN=YOUR_TOKEN_HERE", "export X_TOKEN=********", "export T=$(vault read -field=value ci/x)", "git checkout " + "0a1b2c3d" * 5,
    "cosign verify --key ./keys/release.pub r.test/x:1", "docker pull r.test/x@sha256:" + "0a1b2c3d" * 8, "run-job --id 2630aa40-f339-a8ad-e564-2e42b3726711", 'mysql -u app -p"$MYSQL_PWD" -h db < s',
    'curl -H "Authorization: Bearer ${{ secrets.X }}" https://x', "git fetch ssh://git@r.test/x.git", joined("-----BEGIN ", "PUBLIC KEY-----\n", "QUJD" * 20, "\n-----END ", "PUBLIC KEY-----"), "", "a",
]


@pytest.mark.parametrize("text,value", SECRETS)
def test_credentials_are_found(text, value):
    spans = C.spans_of(text)
    assert len(spans) == 1 and value in text[spans[0][1] : spans[0][2]], spans


@pytest.mark.parametrize("text", HARMLESS)
def test_references_and_placeholders_are_not(text):
    assert C.spans_of(text) == []


SEVERAL = [
    ("openssl pkcs12 -in a.p12 -passin pass:Alder77x -passout pass:Birch88y", ["Alder77x", "Birch88y"]),
    ('curl -H "Authorization: Bearer tok3nAbCdEf12" -u bot:Qw12erty https://x.test', ["tok3nAbCdEf12", "Qw12erty"]),
    ("curl -u a:Firs7one https://x.test -u b:Sec0nd22 https://y.test", ["Firs7one", "Sec0nd22"]),
    ("redis-cli -u redis://app:Zebra99pool@r.test -a Tern4443", ["Zebra99pool", "Tern4443"]),
    ("the key was Password1= hunter22 --x", ["Password1=", "hunter22"]),
    ("openssl rsa -passin pass:xpass:Cedar99 -out k", ["xpass:Cedar99"]),
]


@pytest.mark.parametrize("text,values", SEVERAL)
def test_a_command_hides_none_of_its_credentials(text, values):
    assert [text[a:b] for _, a, b in C.spans_of(text)] == values


def test_chunks_give_the_spans_of_the_whole(spark):
    rnd = random.Random(2)
    texts = []
    for i in range(12):
        parts = [rnd.choice(["go test ./... && "] * 6 + [s + "\n" for s, _ in SECRETS]) for _ in range(40)]
        texts.append((i, "".join(parts)))
    # Contexts longer than any chunk, also over continued lines, and starts inside words.
    texts.append((20, "openssl " + "x " * 400 + "-passin pass:Alder77x " + "\\\n y" * 300 + "pass:Birch88y"))
    texts.append((21, "mysql " + "compass=" * 3 + "z " * 300 + " -pHn8quick && a" + "b" * 500 + "password=Oak99tree"))
    df = spark.createDataFrame([*texts, (98, None), (99, ""), texts[0]], "id long, t string")
    want = {(i, a, b) for i, t in texts for _, a, b in C.spans_of(t)}
    for chunk, overlap in ((300, 120), (90, 40), (57, 20), (1000, 2)):
        got = [tuple(r) for r in C.credential_spans(df, ["id"], "t", chunk=chunk, overlap=overlap).select("id", "start", "end").collect()]
        assert (set(got), len(got)) == (want, len(want)) and len(want) > 20


def pieces(text, chunk, overlap):
    """The spans of a text from its pieces, or None if one does not tell."""
    step, half, out, at = chunk - overlap, overlap // 2, set(), 0
    while True:
        last = at + chunk >= len(text)
        got = C.spans_of(text[at : at + chunk], None, (half if at else 0, chunk + 1 if last else half + step), at > 0, not last)
        if got is None:
            return None
        out |= {(at + a, at + b) for _, a, b in got}
        if last:
            return {(a, b) for a, b in out if not any((x, y) != (a, b) and x <= a and b <= y for x, y in out)}
        at += step


@pytest.mark.parametrize("seed", range(6))
def test_pieces_tell_the_truth_or_nothing(seed):
    rnd, told = random.Random(seed), 0
    words = [s for s, _ in SECRETS] + [s for s, _ in SEVERAL] + HARMLESS + ["compass", "pass", "password=", "curl ", "openssl ", "\n", " ", "'", '"', "ghp_", "-----BEGIN ", "x" * 30, "é"]
    for _ in range(150):
        text = rnd.choice(["", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))
        want = {(a, b) for _, a, b in C.spans_of(text)}
        chunk = rnd.randint(4, 600)
        got = pieces(text, chunk, rnd.randint(2, chunk - 1))
        told += got is not None and len(text) > chunk
        assert got is None or got == want, (text, chunk)
    assert told > 5


@pytest.mark.parametrize("text", ["-" * 200_000, "curl x " * 30_000, "openssl " + "pass:" * 40_000, "password='" * 20_000, "curl " + "-u a:b " * 28_000, "redis-cli " + "-a abcd " * 25_000])
def test_long_lines_take_time_in_proportion(text):
    C.spans_of(text[:1000])
    began = time.process_time()
    C.spans_of(text)
    assert time.process_time() - began < 10


def test_redaction_changes_only_the_value(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SECRETS)] + [(50, "make test"), (51, None), (52, "")], "id long, t string")
    got = {r.id: r.t for r in C.redacted(df, ["id"], "t").collect()}
    for i, (s, value) in enumerate(SECRETS):
        ((kind, a, b),) = C.spans_of(s)
        assert got[i] == s[:a] + f"<{kind.upper()}>" + s[b:] and value not in got[i]
    assert (got[50], got[51], got[52]) == ("make test", None, "")


def test_credential_strings_of_tables(spark):
    macros = spark.createDataFrame([(1, ["make", None, "", SECRETS[1][0]], "x"), (1, ["make", None, "", SECRETS[1][0]], "x"), (2, None, "x"), (3, [], "x")], "macro_id long, steps array<string>, name string")
    gates = spark.createDataFrame([(5, None, SECRETS[3][0]), (6, SECRETS[5][0], "make")], "gate_id long, gate string, run string")
    assert {tuple(r) for r in C.credential_strings(macros, gates).collect()} == {("macros", 1, "steps", 3), ("tooling_gates", 5, "run", 0), ("tooling_gates", 6, "gate", 0)}


def test_mentions_by_form():
    kinds = lambda t: sorted({m.kind for m in M.mentions_in(t)})
    for t in ("mail a.b@c.example now", "x+y (at) corp [dot] example", "ann AT post DOT invalid"):
        assert kinds(t) == ["email"], t
    for t in ("git clone git@h.test:a/b.git", "npm i @a/b@1.2.3", "https://u:pw@h.test/x", "go get a/b@v0.1.2", "f(a) @ b"):
        assert "email" not in kinds(t), t
    for t in ("at 12 Elm Street, Bo, VT 12345.", "Calle del Pozo 2, 6º A, 19333 Nord", "Nordweg 127, 55632 Copper", "44 bis rue des Ormeaux, 88100 Stein", "Flat 8, 23 Oak Close, Fern C3 8JP"):
        assert "address" in kinds(t), t
    assert "address" not in kinds("Lane 20 of the pipeline and Drive 191 of the store")
    assert M.mentions_in(None) == [] and M.mentions_in("") == []
    (m,) = [m for m in M.mentions_in("see SSN 123 45 6789 there") if m.kind == "number"]
    assert m.seed == "id_number"


def corpus():
    rnd = random.Random(4)
    given, family = ["Anna", "Bruno", "Clara", "Dario", "Elena", "Felix"], ["Vandstrom", "Haskelli", "Brackmere", "Thornquist", "Selora", "Tarnmund"]
    docs, names = [], []
    for i in range(240):
        g, f = rnd.choice(given), rnd.choice(family)
        line = rnd.choice([
            f"Reviewed-by: {g} {f} <{g.lower()}.{f.lower()}@mail.example>", f"Please ask {g} {f} before the merge.", f"Mr. {f} told us that it works.", f"{g} {f} told us that it works.",
            f"We met with {f}, {g} yesterday.", f"thanks {g.lower()} {f.lower()} for the fix", f"cc {g} {f} on the follow-up.",
        ])
        docs.append((i, f"The Scope Guard and the Package Rules run.\n{line}\nLock Keeper is a tool, size=505.951.056 bytes"))
        names.append((i, 2, "name"))
    for i in range(300, 360):
        word, bare = ("SSN ", "") if i % 2 else ("", "")
        value = f"{rnd.randint(100, 999)} {rnd.randint(10, 99)} {rnd.randint(1000, 9999)}" if i % 2 else f"{rnd.randint(100, 999)}.{rnd.randint(100, 999)}.{rnd.randint(100, 999)}-{rnd.randint(10, 99)}"
        docs.append((i, f"Someone pasted {word}{value} into the ledger."))
        names.append((i, 1, "id_number"))
    return docs, names


def test_bootstrapping_finds_names_and_numbers_without_own_form(spark):
    docs, want = corpus()
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "  \n"), docs[0]], "doc_id long, text string")
    got = {tuple(r) for r in pii.personal_lines(df).collect()}
    assert {r for r in got if r[2] in ("name", "id_number")} == set(want)


def test_anonymised_text(spark):
    docs, _ = corpus()
    df = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.anonymised(df).collect()}
    assert len(got) == len(docs) + 2 and got[900].text is None and (got[901].text, got[901].n_mentions) == ("", 0)
    for i, text in docs:
        assert got[i].n_mentions >= 1
        assert ("<NAME>" in got[i].text) or ("<ID_NUMBER>" in got[i].text)
        assert got[i].text.split("\n")[0] == text.split("\n")[0] or i >= 300


def test_long_runs_are_candidates_too():
    numbers = lambda t: [(t[m.start : m.end], m.seed) for m in M.mentions_in(t) if m.kind == "number"]
    assert numbers("Tel: 020 7946 0958 / 020 7946 0959") == [("020 7946 0958", "phone"), ("020 7946 0959", "phone")]
    assert numbers("Tel: 020 7946 0958/020 7946 0959") == [("020 7946 0958", "phone"), ("020 7946 0959", "phone")]
    assert numbers("call 0049 30 7946 09581 2024-01-31")[0] == ("0049 30 7946 09581", "phone")
    assert numbers("Tel: 020 7946 0958 020 7946 0959") == [("020 7946 0958 020 7946 0959", "phone")]
    names = {text[m.start : m.end] for text in ["JOHN SMITH, MARY JONES, PETER BROWN <p.brown@mail.example>"] for m in M.mentions_in(text) if m.kind == "name"}
    assert {"JOHN SMITH", "MARY JONES", "PETER BROWN"} <= names


def test_texts_without_id_are_masked(spark):
    rows = [(None, "mail a.b@c.example now"), (2**60 + 1, "mail a.b@c.example now"), (None, "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(None, "mail <EMAIL> now", 1), (2**60 + 1, "mail <EMAIL> now", 1), (None, "nothing", 0)}
    assert {tuple(r) for r in pii.anonymised(df).collect()} == want
    assert {tuple(r) for r in pii.personal_lines(df).collect()} == {(2**60 + 1, 1, "email")}


def test_empty_corpus(spark):
    assert pii.personal_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_nodes_change_no_score(spark):
    docs, _ = corpus()
    found = pii.mentions(spark.createDataFrame(docs, "doc_id long, text string"))
    get = lambda hot: {(r.kind, r.inst): tuple(round(r[s], 9) for s in ("s_0", "s_1", "s_2")) for r in pii.instance_scores(found, 2, hot)[0].collect()}
    cold, hot = get(200_000), get(3)
    assert cold == hot and len(cold) > 10


def test_spelled_out_addresses_are_found_by_the_graph(spark):
    docs = [(i, f"mail anna{i}@corp.example or call") for i in range(6)] + [(10, "mail bruno (at) corp [dot] example or call"), (11, "see x (at) y [dot] zz")]
    docs += [(20 + i, f"lives at {i + 2} Cedar Street, Bramford, VT 12345 since May") for i in range(6)] + [(30, "lives at 9 Cedar Street since May")]
    df = spark.createDataFrame([*docs, *[(100 + i, docs[0][1]) for i in range(50)]], "doc_id long, text string")
    got = {tuple(r) for r in pii.personal_lines(df).collect()}
    want = {(i, 1, "email") for i in [*range(6), 10, *range(100, 150)]} | {(i, 1, "address") for i in [*range(20, 26), 30]}
    assert got == want


def test_overlapping_spans_become_one(spark):
    rows = [(1, 0, 4, "name"), (1, 2, 9, "email"), (1, 3, 5, "phone"), (1, 9, 11, "phone"), (2, 5, 6, "name")]
    df = spark.createDataFrame(rows, "k long, start int, end int, kind string")
    got = {r.k: [tuple(s) for s in r.spans] for r in pii.merged_spans(df, ["k"]).collect()}
    assert got == {1: [(0, 9, "name"), (9, 11, "phone")], 2: [(5, 6, "name")]}


def test_long_texts_take_time_in_proportion():
    text = "Please ask Anna Brackmere <anna.brackmere@mail.example> or call +44 20 7946 0958 at 12 Elm Street, Bo, VT 12345.\n"
    began = time.process_time()
    found = M.mentions_in(text * 5000)
    assert len(found) >= 20_000 and time.process_time() - began < 60
    taken = [(0, 3), (5, 6), (9, 20)]
    for a in range(22):
        for b in range(a + 1, 23):
            assert M._free(taken, a, b) == (not any(a < y and x < b for x, y in taken))


def test_names_beside_their_number_and_telling_forms_are_seeds():
    seeds = lambda t: {(t[m.start : m.end], m.seed) for m in M.mentions_in(t) if m.seed}
    assert ("Paul Thornquist", "name") in seeds('# maintainer = "Paul Thornquist"  # call 702.555.0155')
    assert seeds("| Maria Zellidge | 1 80 12 83 500 007 23 | 20 |") == {("Maria Zellidge", "name"), ("1 80 12 83 500 007 23", "id_number")}
    assert ("Naomi Bracksen", "name") in seeds("Attn. Naomi Bracksen")
    assert ("QQ 79 40 11 D", "id_number") in seeds("noted QQ 79 40 11 D and")
    assert not {s for s in seeds("Strict Mode 617-555-0152 and PARSER STATE (call 617-555-0152") if s[1] == "name"}
