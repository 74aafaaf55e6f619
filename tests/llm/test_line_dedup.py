import re

from lodestone.llm import line_dedup


def _norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _brute(rows, prints):
    """{doc_id: dropped places} by comparing all lines; prints: {normalised line: fingerprint}."""
    lines = [(i, at, _norm(x)) for i, t in rows if t is not None for at, x in enumerate(t.split("\n")) if len(_norm(x).split()) >= 5]
    names = sorted({n for _, _, n in lines})
    label = {n: min((i, at) for i, at, m in lines if m == n) for n in names}
    links = [(a, b) for a in names for b in names if (prints[a] ^ prints[b]).bit_count() <= 3 and _edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    for _ in names:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    out = {i: [] for i, _ in rows}
    for i, at, n in lines:
        if (i, at) != label[n]:
            out[i].append(at)
    return {i: sorted(x) for i, x in out.items()}


def _prints(spark, rows):
    found = line_dedup.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    at = {(r["doc_id"], r["line_no"]): r["fp"] for r in found}
    return {_norm(t.split("\n")[k]): fp for (i, k), fp in at.items() for j, t in rows if j == i}


def test_equals_brute_force_with_a_crowded_block(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "NEIGHBOURS", 2)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(45):  # one word differs in each, so that their fingerprints are close
        own = list(base)
        own[k] = own[k] + "x" * (1 + k % 3)
        texts.append(" ".join(own))
    rows = [(k, f"short line\n{x}\nthe same line stands in every document") for k, x in enumerate(texts)]
    rows += [(100, "The SAME line, stands in every document!\nquite other words are written in this one"), (101, None), (102, ""), (103, "a b c\na b c"), (104, "\n".join(["one two three four five"] * 3))]
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _brute(rows, _prints(spark, rows))
    assert {i: r["dropped"] for i, r in got.items()} == want
    assert any(1 in want[k] for k in range(1, 45))
    assert got[104]["text"] == "one two three four five" and got[104]["dropped"] == [1, 2]
    assert got[101]["text"] is None and got[102]["text"] == "" and got[103]["text"] == "a b c\na b c"


def test_fingerprint_bits(spark):
    line = "alpha beta gamma delta epsilon alpha zeta"
    hashes = [r[0] for r in spark.createDataFrame([(w,) for w in dict.fromkeys(line.split())], "w string").selectExpr("xxhash64(w)").collect()]
    want = sum(1 << b for b in range(line_dedup.LANES * line_dedup.EACH) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    got = line_dedup.fingerprinted(spark.createDataFrame([(1, line), (1, line)], "doc_id long, text string")).collect()
    assert [r["fp"] for r in got] == [want, want]  # a row that repeats gives its lines again


def test_empty_repeats_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, line_no string")
    assert line_dedup.report(empty).collect() == []
    rows = [(3, "five words stand in here", "x"), (3, "five words stand in here", "x"), (1, "Five words stand, in here", "y"), (None, "five words stand in here", "z")]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, digest string"))
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect()) == [(-1, "five words stand in here"), (1, "Five words stand, in here"), (3, ""), (3, "")]


def test_later_lines_of_a_fingerprint_meet_each_other_and_near_fingerprints(spark, monkeypatch):
    first = [f"w{i}" for i in range(60)]
    later = first[::-1]
    swapped = later[:7] + [later[8], later[7]] + later[9:]
    edited = [later[:k] + [later[k] + "x"] + later[k + 1 :] for k in range(40)]
    texts = [" ".join(words) for words in (first, later, swapped, *edited)]
    prints = _prints(spark, [(k, x) for k, x in enumerate(texts)])
    fp = prints[texts[0]]
    near = [x for x in texts[3:] if 0 < (prints[x] ^ fp).bit_count() <= 3]
    assert prints[texts[1]] == prints[texts[2]] == fp and near
    for most, chosen in ((8, near[:1]), (8, near), (2, texts[3:])):
        monkeypatch.setattr(line_dedup, "NEIGHBOURS", most)
        rows = list(enumerate(texts[:3] + chosen))
        got = {r["doc_id"]: r["dropped"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == _brute(rows, prints)
        assert got[1] == [] and got[2] == [0] and all(got[k] == [0] for k, x in rows[3:] if x in near)


def test_long_lines_are_counted_whole(spark):
    words = [f"w{k}" for k in range(2000)]
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w)").collect()}
    rows = [(n, " ".join(words[:n])) for n in (5, 255, 256, 257, 511, 512, 513, 2000)]
    got = {r["doc_id"]: r["fp"] for r in line_dedup.fingerprinted(spark.createDataFrame(rows + rows, "doc_id long, text string")).collect()}
    for n, _ in rows:
        assert got[n] == sum(1 << b for b in range(60) if 2 * sum(hashes[w] >> b & 1 for w in words[:n]) > n)


def test_ids_that_repeat_with_other_texts(spark):
    rows = [(1, "a line of five words\nanother line that stays here"), (2, "x\na line of five words"), (2, "a line of five words\ny"), (2, "x\na line of five words"), (2, "some other words in here")]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"], r["dropped"]) for r in out) == sorted([(1, rows[0][1], []), (2, "x", [1]), (2, "y", [0]), (2, "x", [1]), (2, rows[4][1], [])])


def test_words_are_counted_where_the_text_is_read(spark, monkeypatch):
    written, write = {}, line_dedup.common.materialise
    monkeypatch.setattr(line_dedup.common, "materialise", lambda df, name: written.setdefault(name, df) and write(df, name))
    words = [f"w{k}" for k in range(300)]
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w)").collect()}
    rows = [(n, " ".join(words[:n] + words[:3])) for n in (5, 30, 31, 32, 61, 62, 63, 124, 125, 256, 257)]
    got = {r["doc_id"]: r["fp"] for r in line_dedup.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: sum(1 << b for b in range(60) if 2 * sum(hashes[w] >> b & 1 for w in words[:n]) > n) for n, _ in rows}
    plan = written["lines"]._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and "split(lower" not in plan
    assert written["lines"].count() == sum(-(-n // 62) for n, _ in rows)  # a row for 62 words, not one for each


def test_edits_of_words_bound_the_distance(spark):
    base = [f"word{k % 23}x{k}" for k in range(40)]
    shifted = [base[:k] + ["more"] * (1 + k % 3) + base[k : k + 9] + base[k + 10 + k % 5 :] for k in range(0, 36, 4)]
    others = [base[::-1], [f"b{k}" for k in range(40)], base[:1] + ["e"] + base[1:], ["ä" * 9, *base, "z"], [f"many{k}" for k in range(300)]]
    pairs = [(" ".join(base), " ".join(o), m) for o in shifted + others for m in (5, 20, 40, 60, 90)]
    frame = spark.createDataFrame(pairs, "x string, y string, most int").selectExpr("x as p", "y as q", "*", "abs(length(x) - length(y)) as apart")
    got = line_dedup._judged(frame).select("p", "q", "most", "near", line_dedup._few_words().alias("few")).collect()
    assert len(got) == len(pairs) and all(r["near"] == (_edit(r["p"], r["q"]) <= r["most"]) for r in got)
    assert any(r["few"] for r in got) and all(r["near"] for r in got if r["few"])
