import hashlib
import hmac

from pyspark.sql import functions as F

from sparkloom.functions import attest, code, content, paths, transcripts

DENIED = [".env", "a/.env.local", "C:\\x\\.ENV", "k/server.pem", "id_rsa", "a/id_ed25519.pub", "x/.ssh/config", ".aws/credentials", "app-secrets.yml", "my-credential-store.txt", ".npmrc", "a.KEY", "a/secrets.json"]
ALLOWED = ["environment.ts", "a/.environment", "keyboard.ts", "pem.txt", "secretary.md", "src/id_card.ts", ""]


def test_secret_paths(spark):
    df = spark.createDataFrame([(p,) for p in [*DENIED, *ALLOWED, None]], "p string")
    got = {r.p: r.s for r in df.select("p", paths.is_secret(F.col("p")).alias("s")).collect()}
    assert all(got[p] for p in DENIED) and not any(got[p] for p in [*ALLOWED, None])
    globs = df.select(paths.is_secret(F.lit("db/a.sql"), "*.sql,notes-private.md").alias("a"), paths.is_secret(F.lit("a.sql/b"), "*.sql").alias("b"), paths.is_secret(F.lit("NOTES-private.md"), "*.sql, notes-private.md").alias("c"), paths.is_secret(F.lit("x"), None, F.lit("/home/.ssh/k")).alias("d")).first()
    assert tuple(globs) == (True, False, True, True)


def test_git_ids_and_sizes(spark):
    r = spark.createDataFrame([("hello\n",), ("é😀",)], "t string").select(content.git_blob_sha1(F.col("t")), content.byte_size(F.col("t")), content.approx_tokens(F.col("t")), content.content_hash(F.col("t"))).collect()
    assert r[0][0] == "ce013625030ba8dba906f756967f9e9ca394464a" and tuple(r[0][1:3]) == (6, 2)
    assert tuple(r[1][:3]) == (hashlib.sha1("blob 6\0é😀".encode()).hexdigest(), 6, 1)


def test_binary(spark):
    rows = [(b"",), (b"abc",), (b"a\x00b",), (b"\x01" * 4 + b"abcdef",), (b"\t\n\r" * 9,), (b"a" * 8192 + b"\x00",), ("é".encode() * 20,)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(content.looks_binary(F.col("b"))).collect()]
    assert got == [False, False, True, True, False, False, False]


def test_views_ranges_and_texts(spark):
    df = spark.createDataFrame([(None, "2 - 9", 5), ("f", "1-2", 5), (None, "x", 5), (None, "9-1", 5)], "s string, l string, n int")
    assert [r[0] for r in df.select(paths.view_key(F.col("s"), F.col("l"), F.col("n"))).collect()] == ["lines:2-5", "sym:f", "full", "lines:5-5"]
    row = spark.range(1).select(content.slice_lines(F.lit("a\nb\nc"), F.lit(2), F.lit(9)).alias("a"), content.slice_lines(F.lit("a\nb\nc"), F.lit(-3), F.lit(-9)).alias("b"), content.usd(F.lit(1234567)).alias("c"), content.age_text(F.lit(400)).alias("d"), content.age_text(F.lit(150_000)).alias("e"), content.language_family(F.lit("a/B.PY")).alias("f")).first()
    assert tuple(row.a) == ("b\nc", 2, 3) and tuple(row.b) == ("a", 1, 1) and tuple(row[2:]) == ("$3.7037", "1s ago", "3min ago", "indent")


TS = '''import x
// function fake() { not this }
export function outer(a: string) {
  const s = "}"; /* } */
  if (a) { return `${a} }` }
}
type T =
  | 'a'
  | 'b'
const one = (x) => x + 1
class K {
  method(a: number): void {
    return
  }
}
'''
PY = '''# def f(): no
def f(a):
    if a:
        return "def g():"

    return 2

def g():
	pass
'''


def test_symbols():
    assert code.find_symbol(TS, "outer", "a.ts")[1:] == (3, 6)
    assert code.find_symbol(TS, "T", "a.ts")[1:] == (7, 15)  # a brace within eight lines counts as its own
    assert code.find_symbol(TS, "one", "a.ts")[1:] == (10, 15)
    assert code.find_symbol("const one = (x) => x + 1\nlet b", "one", "a.ts") == ("const one = (x) => x + 1", 1, 1)
    assert code.find_symbol(TS, "method", "a.ts")[1:] == (12, 14)
    assert code.find_symbol(TS, "fake", "a.ts") is None and code.find_symbol(TS, "absent", "a.ts") is None
    assert code.find_symbol(PY, "f", "a.py")[1:] == (2, 6)
    assert code.find_symbol(PY, "g", "a.py")[1:] == (8, 9)


def test_masks_keep_lines_and_hide_contents():
    for path, text in (("a.ts", TS), ("a.py", PY)):
        assert len(code.mask(text, path).split("\n")) == len(text.split("\n"))
    assert code.mask('a = "x\\"}" // {', "a.ts") == 'a = "    "' + " " * 5
    assert code.mask("`a\n}` + '\\\\' + b", "a.ts") == "` \n ` + '  ' + b"
    assert code.mask("x = 1 # {", "a.py") == "x = 1 "


def test_symbol_column(spark):
    df = spark.createDataFrame([(TS, "outer"), (TS, "absent"), (None, "x")], "t string, n string")
    assert [(r.s.start, r.s.end) for r in df.select(code.symbol_slice(F.col("t"), F.col("n"), F.lit("a.ts")).alias("s")).collect()] == [(3, 6), (None, None), (None, None)]


def test_signatures(spark, tmp_path):
    value = {"b": 1, "a": [None, {"z": None, "y": 2.0}], "c": None}
    assert attest.canonical_json(value) == '{"a":[null,{"y":2}],"b":1}'
    s = attest.sign(value, "k")
    assert attest.verify(value, s, "k") and not attest.verify(value, s, "other") and not attest.verify(value, None, "k")
    for key in ("k", "long" * 40):
        got = spark.range(1).select(attest.hmac_sha256(F.lit("méssage"), key)).first()[0]
        assert got == hmac.new(key.encode(), "méssage".encode(), hashlib.sha256).hexdigest()
    file = str(tmp_path / "d" / "key")
    first = attest.receipt_key({"RECEIPT_KEYFILE": file})
    assert first == attest.receipt_key({"RECEIPT_KEYFILE": file}) and (tmp_path / "d" / "key").stat().st_mode & 0o77 == 0
    assert attest.receipt_key({"RECEIPT_KEY": "x"}) == ("x", "env:RECEIPT_KEY")


def test_ancestors(spark):
    got = spark.range(1).select(paths.ancestors(F.lit("/a/b/c.ts")), paths.ancestors(F.lit("C:\\x\\y.ts")), paths.ancestors(F.lit("z"))).first()
    assert got[0] == ["/a/b", "/a", "/"] and got[1] == ["C:/x", "C:"]


LINES = [
    '{"timestamp":"2026-01-01T00:00:01.000Z","toolUseResult":{"file":{"filePath":"/a.ts","content":"A","startLine":1,"numLines":3,"totalLines":3}}}',
    '{"timestamp":"2026-01-01T00:00:02.000Z","toolUseResult":{"file":{"filePath":"/a.ts","content":"A","startLine":10,"numLines":3,"totalLines":100}}}',
    '{"timestamp":"2026-01-01T00:00:03.000Z","message":{"content":[{"type":"tool_use","name":"Edit","id":"1","input":{"file_path":"/b.ts"}},{"type":"tool_use","name":"Grep","input":{"path":"/z"}}]}}',
    '{"timestamp":"2026-01-01T00:00:04.000Z","toolUseResult":{"filePath":"/b.ts","content":"new"}}',
    '{"timestamp":"2026-01-01T00:00:05.000Z","isSidechain":true,"message":{"content":[{"type":"tool_use","name":"Read","input":{"file_path":"/s.ts"}}]}}',
    '{"timestamp":"2026-01-01T00:00:06.000Z","message":{"content":[{"type":"tool_use","name":"mcp__myreader__read_files","input":{"paths":["/p","/q"],"path":"/o"}}]}}',
    '{"timestamp":"2026-01-01T00:00:07.000Z","message":{"content":[{"type":"tool_result","content":[{"type":"text","text":"[context-reader] /r.ts (lines 1-2) — full content\\nx\\n\\n---\\n\\nhead\\n[context-reader] /t.ts is byte-identical"}]}]}}',
    "{{{",
    "",
    '{"type":"summary"}',
    '{"message":{"content":"plain"},"toolUseResult":{"filePath":"/undated"}}',
]


def test_transcript_lines(spark):
    lines = transcripts.parsed(spark.createDataFrame(list(enumerate(LINES)), "line int, value string"))
    t = [(r.line, r.path, r.op, r.sidechain) for r in transcripts.touches(lines, ["line"]).orderBy("line").collect()]
    assert t == [(2, "/b.ts", "edit", False), (4, "/s.ts", "read", True)]
    assert [(r.line, r.path, r.content) for r in transcripts.exact_versions(lines, ["line"]).collect()] == [(0, "/a.ts", "A")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    marks = sorted((r.line, r.key, r.hash) for r in transcripts.seen_marks(lines, ["line"]).collect())
    assert marks == [(0, "/a.ts", sha("A")), (1, "/a.ts", None), (3, "/b.ts", sha("new")), (5, "/o", None), (5, "/p", None), (5, "/q", None), (6, "/r.ts", None), (6, "/t.ts", None)]
    assert [(r.line, r.path, r.hash) for r in transcripts.landed_edits(lines, ["line"]).collect()] == [(3, "/b.ts", sha("new"))]
