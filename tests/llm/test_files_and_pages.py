"""p5 and p8 on small fixtures."""

from codestrata.llm import provenance, residue

SRC = "file_id long, scan_id long, repo string, rel_path string, language string, bytes long, content binary, path string, marked int"
SKIP = "file_id long, scan_id long, repo string, rel_path string, reason struct<tag string, bytes bigint, limit_bytes bigint, msg string>"
HAND = "import os\n\n\ndef walk(top):\n    for name in os.listdir(top):\n        yield name\n"


def src(i, path, text, repo="o/r"):
    return (i, 1, repo, path, None, 1, None if text is None else text.encode(), "clash", 0)


def test_reasons(spark):
    library = "export function lens(a) {\n  return a.map((x) => x + 1);\n}\n"
    files = [
        src(1, "src/a.py", HAND), src(2, "src/b.py", "# Code generated by tool. DO NOT EDIT.\n" + HAND), src(3, "codegen/emit.py", 'HEADER = "Code generated by tool. DO NOT EDIT."\n' + HAND), src(4, "api/x_pb2.py", HAND),
        src(5, "third_party/lens/lens.js", library), src(6, "src/util/lens.js", "// helper\n" + library), src(7, "lib/t.py", "ROWS = [\n" + "".join(f"    {i}, 0x{i:x},\n" for i in range(200)) + "]\n"),
        src(8, "src/m.js", "!function(e,t){" + "var n=e;t(n+1);" * 80 + "}()"), src(9, "src/vendors/form.tsx", HAND), src(10, "src/n.py", None), src(11, "src\\external\\u.py", None), src(12, None, HAND), src(13, "src/e.py", ""),
        src(14, "d/.gitattributes", "*.py linguist-generated\nkeep/** -linguist-generated\n"), src(15, "d/x.py", HAND), src(16, "d/keep/y.py", HAND), src(17, "d/sub/.gitattributes", "/z.py -linguist-generated\n"), src(18, "d/sub/z.py", HAND), src(19, "d/sub/deep/z.py", HAND), src(15, "d/x.py", HAND)]
    skipped = [(100, 1, "o/r", "a/b.ts", ("TooLarge", 1, 2, None)), (101, 1, "o/r", "a/c.test.ts", ("Excluded", None, None, None)), (102, 1, "o/r", "static/q.min.js", ("Excluded", None, None, "")), (103, 1, "o/r", "x.py", None), (104, 1, None, "x.rs", ("Binary", None, None, None)), (105, 1, "o/r", None, None)]
    out = {r.file_id: r.reason for r in provenance.machine_files(spark.createDataFrame(files, SRC), spark.createDataFrame(skipped, SKIP)).collect()}
    assert out == {2: "generated", 4: "generated", 5: "vendored", 6: "vendored", 7: "data", 8: "minified", 11: "vendored", 15: "generated", 19: "generated", 100: "data", 102: "generated", 104: "data"}
    assert provenance.machine_files(spark.createDataFrame([], SRC), spark.createDataFrame([], SKIP)).count() == 0


def test_marks_of_copies_count_anywhere():
    late = "".join(f"# step {i} of the walk\nx{i} = {i}\n" for i in range(200)) + "# Vendored from lens 1.2\n" + HAND
    assert provenance.traits("a.py", late.encode())[1]
    assert not provenance.traits("a.py", late.replace("Vendored from", "A kind of").encode())[1]


def test_patterns_are_mined_from_declared_repositories(spark):
    files = []
    for r in range(4):
        files += [src(100 * r, ".gitattributes", "gen_out/** linguist-generated\n", f"d/{r}"), src(100 * r + 90, "node_modules/z.py", HAND, f"d/{r}")] + [src(100 * r + i, f"gen_out/f{i}.py", HAND + f"N = {r}{i}\n", f"d/{r}") for i in range(1, 5)]
    files += [src(900, "gen_out/x.py", HAND + "A = 1\n", "u/u"), src(901, "src/x.py", HAND + "B = 1\n", "u/u"), src(902, "third_party/e.py", "# a\n", "u/u"), src(903, "src/e.py", "# b\n", "u/u")]
    out = {r.file_id for r in provenance.machine_files(spark.createDataFrame(files, SRC), spark.createDataFrame([], SKIP)).collect()}
    assert out == {100 * r + i for r in range(4) for i in range(1, 5)} | {900, 902}


def test_mined_patterns(spark):
    looked = [(f"r{i % 5}", f"gen_out/f{i}.ts", i != 3) for i in range(20)] + [(f"r{i % 5}", f"src/g{i}.ts", i < 2) for i in range(20)]
    df = spark.createDataFrame(looked, "repo string, path string, marked boolean")
    assert [r.shape for r in provenance.mined_shapes(df).collect()] == ["**/gen_out/**"]


DOCS = "doc_id long, text string, lang string, skeleton int"


def test_residue(spark):
    real = "The walker counts the edges. It needs a test."
    texts = {
        1: real, 2: "Dear {{ author }}, thank you for the report about ${TITLE}.", 3: "The engine writes `{{ author }}` here.", 4: "```\nx = ${TITLE}\n```\nIt works.", 5: "Lorem ipsum dolor sit amet, lorem ipsum.", 6: real + "\n\nYour description goes here.",
        7: "404 Not Found\n\nReload the page in a moment.", 8: "Access denied.\n\nReload the page in a moment.\n\nID: 3-4-x", 9: "Please enable JavaScript to view this page.", 10: "We show 'please enable JavaScript' inside the tag; the wording should change.", 11: "Bitte aktivieren Sie JavaScript, um fortzufahren.",
        12: "Rate limit exceeded is what the client logs.", 13: None, 14: "", 15: "  \n", 16: "# title\n\nVersion [INSERT DATE] adds <owner goes here> fixes.", 17: '{"status": 503, "error": "Access denied.", "path": "/x"}', 18: "<html><body><h1>403 Forbidden</h1></body></html>", 19: "Welcome to «Date»! By {date} and %(date)s and @@DATE@@.",
        20: "Set {name} in the form.", 21: "x " * 50_000 + "end."}
    rows = [(i, t, None, 0) for i, t in texts.items()] + [(None, "Access denied.", None, 0), (2, texts[2], None, 0)]
    out = {r.doc_id: r.reason for r in residue.residue(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {2: "slot", 5: "filler", 6: "filler", 7: "page", 8: "page", 9: "page", 11: "page", 16: "slot", 17: "page", 18: "page", 19: "slot"}
    assert residue.residue(spark.createDataFrame([], DOCS)).count() == 0


def test_residue_induces_slots(spark):
    filled = [f"Contact {n} with questions about the lens." for n in "Anna Ben Carla Dora".split()] + [f"Name: {n} Meier" for n in "Anna Ben Carla Dora".split()] + [f"担当者は{n}です。" for n in ("北山", "中村", "小林", "石井")]
    left = ["Contact ~name~ with questions about the lens.", "Contact TBD with questions about the lens.", "Contact ____ with questions about the lens.", "Name: ____", "担当者は____です。"]
    left += ["Dear customer, your order has been shipped."] * 10
    filled += [f"Dear {n}, your order has been shipped." for n in "Anna Ben Carla Dora Emil Fay Gus Hal Ida Jon Kim Lea".split()]
    alone = ["Press ~ok~ in the old dialog.", "Rows: ____"]
    rows = [(i, t, None, 0) for i, t in enumerate([*left, *filled, *alone])]
    out = {r.doc_id: r.reason for r in residue.residue(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(out) == set(range(len(left)))


def test_residue_finds_repeated_pages(spark):
    hosts = "kestrel heron plover avocet dunlin curlew".split()
    left = [f"The kiosk named {h} is resting now." for h in hosts] + [f"抱歉，{h}正在休息，请稍后再来。" for h in ("北京站", "上海站", "广州站", "杭州站", "成都站")]
    long = "Gate closed while {} sleeps, and everybody who came here to read the catalogue of the old collection should therefore wait at the small door beside the tall tower."
    left += [long.format(h) for h in hosts]
    real = ["Nothing else changed."] * 6 + [f"Row {w} came first. Nothing else changed. The kernel was {w}." for w in "a b c d e f g".split()] + ["Update the heron page.", "The heron is resting now."]
    rows = [(i, t, ["web", "issue"][i % 2]) for i, t in enumerate([*left, *real])]
    out = {r.doc_id: r.reason for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out == {i: "page" for i in range(len(left))}
    one_kind = spark.createDataFrame([(i, "Initial commit of all files.", "commit") for i in range(9)] + [(i, f"The gate at {h} is shut.", s) for i, (h, s) in enumerate(zip(hosts, ["web", "issue"] * 3), 20)], "doc_id long, text string, source string")
    assert {r.doc_id for r in residue.residue(one_kind).collect()} == set(range(20, 26))


LONG_PAGE = ["The kiosk named {} is resting now.", *[f"Bench {w} waits beside the kiosk wall." for w in "amber birch cedar dusk elder fern gorse hazel ivy".split()], "Please come back when it wakes."]


def test_residue_finds_repeated_pages_of_any_length(spark):
    hosts = "kestrel heron plover avocet dunlin curlew".split()
    left = ["\n".join(LONG_PAGE).format(h) for h in hosts]
    # equal but for two positions, or in too few documents: no pages
    two = ["\n".join(["The {} lamp near gate five is broken.", *[f"Row {w} of the {w} list is empty today." for w in "one two three four five six seven".split()], "Ask the {} clerk about the lamp."]).format(h, h) for h in hosts]
    few = ["\n".join([f"Shelf {w} holds nothing but old {w} jars." for w in "ash bay cob dew elm fir gum".split()])] * 4
    rows = [(i, t, ["web", "issue"][i % 2]) for i, t in enumerate([*left, *two, *few])]
    out = {r.doc_id: r.reason for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out == {i: "page" for i in range(len(left))}
    # the other sentences of a page of which one is usual elsewhere make none
    usual = [(100 + i, f"{LONG_PAGE[3]} Note {w} on {w} is the {i}th.", "web") for i, w in enumerate("a b c d e f g h".split())]
    assert residue.residue(spark.createDataFrame([*rows, *usual], "doc_id long, text string, source string")).count() == 0
