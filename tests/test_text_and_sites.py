import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import printer
from rankloom.functions import text as X
from rankloom.operators import annotate as A
from rankloom.operators import conserve as C
from rankloom.plans.options import RunOptions, check_input, choose_mode
from rankloom.sources import sequences as SQ
from rankloom.sources import tables as TB

GENOME = "acgtacgtaaccggttacgt"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def revcomp(s):
    return s[::-1].translate(str.maketrans("acgt", "tgca"))


def test_reverse_complement_is_an_involution(spark):
    assert one(spark, X.reverse_complement(X.reverse_complement(F.col("s"))), s="acgtNNacGT") == "acgtNNacGT"


@pytest.mark.parametrize("strand,pos,circular,want", [
    (1, 8, True, GENOME[3:11]), (1, 2, True, GENOME[-3:] + GENOME[:5]), (1, 19, True, GENOME[14:20] + GENOME[:2]), (-1, 8, True, revcomp(GENOME[4:12])),
    (1, 2, False, GENOME[:5]), (1, 19, False, GENOME[14:]), (-1, 19, False, revcomp(GENOME[15:])),
])
def test_region_window(spark, strand, pos, circular, want):
    col = X.region_window(F.col("s"), F.col("c"), F.col("d"), F.col("p"), 4, 4, 2)
    assert one(spark, col, s=GENOME, c=circular, d=strand, p=pos) == want


def test_short_linear_window_is_dropped(spark):
    assert one(spark, X.region_window(F.col("s"), F.lit(False), F.lit(1), F.col("p"), 4, 4, 150), s=GENOME, p=2) is None


def test_anchor(spark):
    assert one(spark, X.window_anchor("3utr", F.lit(-1), F.col("a"), F.col("b")), a=5, b=9) == 4
    with pytest.raises(ValueError):
        X.window_anchor("cds", F.lit(1), F.lit(1), F.lit(2))


def test_cell_round_trip(spark):
    cell = "b0001(thrL|-10.5|0.001|3|20|5|25|GeneID:944742)"
    got = one(spark, X.unpack_cell(F.col("c")), c=cell)
    assert (got["locus"], got["gene"], got["energy"], got["p"], got["start1"], got["end2"], got["gene_id"]) == ("b0001", "thrL", -10.5, 0.001, 3, 25, "944742")
    assert one(spark, X.unpack_cell(F.col("c")), c="") is None


def test_gapped_positions(spark):
    assert one(spark, X.aligned_position(F.col("s"), F.col("p")), s="ac-gt", p=3) == 4
    assert one(spark, X.aligned_position(F.col("s"), F.col("p")), s="ac-gt", p=9) is None


def test_overlap_share(spark):
    assert one(spark, X.overlap_share(F.lit(1), F.lit(10), F.lit(6), F.lit(9)), a=1) == 1.0
    assert one(spark, X.overlap_share(F.lit(1), F.lit(10), F.lit(20), F.lit(29)), a=1) == 0.0


@pytest.mark.parametrize("group,n,color", [(1, 3, "#00ff00"), (3, 3, "#ff0000"), (2, 4, "#00ffff")])
def test_colors(spark, group, n, color):
    assert one(spark, X.hsv_hex(X.hue(F.col("g"), F.col("n")), F.lit(1.0)), g=group, n=n) == color


def test_codes_differ(spark):
    rows = spark.range(1, 3000).select(X.organism_code(F.col("id")).alias("c")).distinct()
    assert rows.count() == 2999 and rows.where("length(c) <> 4").count() == 0


def test_peaks():
    flat = np.array([0, 1, 2, 5, 5, 2, 1, 0.0])
    assert C.two_peaks(flat) == [(3, 6)]  # down to 0.4 of the maximum
    base = np.r_[np.linspace(0.1, 1.2, 12), [10, 10, 10], np.linspace(1.2, 0.1, 12)]
    second = np.r_[base, [9.5, 9.5], [0.05]]
    assert len(C.two_peaks(second)) == 2
    assert len(C.two_peaks(np.r_[base, [8.5, 8.5], [0.05]])) == 1


def test_coverage_and_peak_frames(spark):
    iv = spark.createDataFrame([(1, 1, 4, 0.5), (1, 3, 6, 0.0), (2, 10, 10, 0.9)], "cluster int, start1 int, end1 int, p double")
    got = {(r["cluster"], r["pos"]): round(r["weight"], 6) for r in C.coverage(iv).collect()}
    assert got == {(1, 1): 0.5, (1, 2): 0.5, (1, 3): 1.5, (1, 4): 1.5, (1, 5): 1.0, (1, 6): 1.0, (2, 10): 0.1}
    peak = {r["cluster"]: (r["start"], r["end"]) for r in C.peaks(C.coverage(iv)).collect()}
    assert peak == {1: (3, 6), 2: (10, 10)}


def _lines(*lines):
    return "".join(x.replace(" ", "_") + "\\n" for x in lines)


def drawn(spark, *lines):
    df = spark.createDataFrame([lines], "a string, b string, c string, d string, t string, q string")
    return df.select(printer.picture(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


def test_picture_with_flanks(spark):
    """Two bases on the left of either strand, two on the right; drawn by hand."""
    got = drawn(spark, "5'-GC      UU-3'", "AGCCAG", "UCGGUC", "3'-AA      CG-5'", "4 -- 9", "6 -- 11")
    assert got == _lines(
        "             3      10",
        "             |      |",
        "         5'-GC      UU-3'",
        "              AGCCAG",
        "              ||||||",
        "              UCGGUC",
        "         3'-AA      CG-5'",
        "             |      |",
        "             12     5",
    )


def test_picture_without_flanks(spark):
    """Strands that end with the interaction, a wobble pair and a mismatch; drawn by hand."""
    got = drawn(spark, "5'-     -3'", "GAUGA", "UUACC", "3'-     -5'", "1 -- 5", "1 -- 5")
    assert got == _lines(
        "              1   5",
        "              |   |",
        "           5'-     -3'",
        "              GAUGA",
        "              :||| ",
        "              UUACC",
        "           3'-     -5'",
        "              |   |",
        "              5   1",
    )


def test_long_flanks_are_shortened(spark):
    text = drawn(spark, "5'-ACGGAUUACAGAUUA    A-3'", "CAGU", "GUCA", "3'-A    GG-5'", "16 -- 19", "3 -- 6")
    assert "5'-ACG...GAUUA" in text.replace("_", " ")


def _plain(line1, line2, line3, line4, target, query):
    """The picture in plain Python."""
    def ends(line):
        words = line.split()
        left, right = (words[0], words[-1] if len(words) > 1 else "") if words else ("", "")
        return left, line.strip()[len(left) : len(line.strip()) - len(right)], right

    short_left = lambda x: f"{x[:6]}...{x[-5:]}" if len(x) > 11 else x.rjust(14)
    short_right = lambda x: f"{x[:5]}...{x[-6:]}" if len(x) > 11 else x
    pairs = {"AU": "|", "UA": "|", "GC": "|", "CG": "|", "GU": ":", "UG": ":"}
    (a, above, b), (c, below, d), up, low = ends(line1), ends(line4), line2.strip(), line3.strip()
    t, q = [int(x) for x in target.split(" -- ")], [int(x) for x in query.split(" -- ")]

    def ruler(width, left, right, x, y):
        bare = (len(left) == 3) + (len(right) == 3)
        x, y = x + (len(left) == 3), y - (len(right) == 3)
        pad = " " * (13 + (len(left) == 3))
        return pad + str(x) + " " * max(0, 1 + width - len(str(x)) - bare) + str(y), pad + "|" + " " * max(0, width - bare) + "|"

    def low_ruler():
        bl, br = len(c) == 3, len(d) == 3
        x, y, pad = q[1] + 1 - bl, q[0] - 1 + br, " " * (13 + bl)
        return pad + str(x) + " " * max(0, 1 + len(low) - len(str(x)) - bl - br) + str(y), pad + "|" + " " * max(0, len(low) - bl - br) + "|"

    top, bottom, indent = ruler(len(up), a, b, t[0] - 1, t[1] + 1), low_ruler(), " " * len(short_left(a))
    marks = "".join(pairs.get(x + y, " ") for x, y in zip(up, low.ljust(len(up))))
    return _lines(*top, short_left(a) + above + short_right(b), indent + up, indent + marks, indent + low, short_left(c) + below + short_right(d), bottom[1], bottom[0])


def test_pictures_equal_plain_ones(spark):
    rng = random.Random(4)
    word = lambda low, high: "".join(rng.choice("ACGU") for _ in range(rng.randint(low, high)))
    rows = []
    for _ in range(300):
        n, place = rng.randint(1, 30), rng.choice([1, 9, 95, 999, 12345])
        gap = " " * rng.randint(1, 30)
        rows.append((f" 5'-{word(0, 14)}{gap}{word(0, 14)}-3' ", f"   {word(n, n)}", f"{word(max(1, n - 2), n)}  ", f"3'-{word(0, 14)}{gap}{word(0, 14)}-5'", f"{place} -- {place + n}", f"{place * 3} -- {place * 3 + n}"))
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, t string, q string").repartition(3)
    got = df.select("*", printer.picture(*[F.col(c) for c in df.columns]).alias("x")).collect()
    assert [r["x"] for r in got] == [_plain(*r[:6]) for r in got]


def test_pictures_of_missing_and_odd_lines(spark):
    good = ("5'-GC  UU-3'", "AG", "UC", "3'-AA  CG-5'", "4 -- 5", "6 -- 7")
    assert drawn(spark, *good) is not None
    for k in range(6):
        assert drawn(spark, *good[:k], None, *good[k + 1 :]) is None
    assert drawn(spark, *good[:4], "x -- 5", good[5]) is None and drawn(spark, *good[:4], good[4], "") is None
    assert drawn(spark, "", "", "", "", "4 -- 5", "6 -- 7").count("\\n") == 9


def test_interactions_of_a_report(spark):
    def report(locus, mark, n=20):
        lines = [f"target: {locus}", *[""] * 4, f"5'-{mark}  A-3'", " AG", " UC", "3'-A  A-5'", "", "", f"a: b: {mark}1", "", "", f"s: {mark}2", "", f"u: {mark}3", f"v: {mark}4", f"h: {mark}5", "tail"]
        return lines[:n]

    text = ["before"] + report("G1", "x") + report("g2", "y", 13) + report("g1", "z") + report("g3", "w")
    lines = spark.createDataFrame([("b", i, v) for i, v in enumerate(text)] + [("a", i, v) for i, v in enumerate(report("g3", "first"))], "file string, line_no int, value string").repartition(3)
    got = {r["locus"]: r for r in TB.interactions(lines).collect()}
    assert set(got) == {"g1", "g2", "g3"}
    assert (got["g1"]["seed_target"], got["g1"]["seed_query"], got["g1"]["hybrid_energy"], got["g1"]["line2"]) == ("x1", "x2", "x5", " AG")
    assert (got["g2"]["seed_target"], got["g2"]["seed_query"], got["g2"]["hybrid_energy"]) == ("y1", None, None)
    assert (got["g3"]["seed_target"], got["g3"]["unfolding_target"], got["g3"]["unfolding_query"]) == ("first1", "first3", "first4")
    rows = spark.createDataFrame([(1, "G1(a|1|0.5|4|5|6|7|GeneID:3)", 0.2), (2, "g9(b|1|0.5|4|5|6|7|GeneID:4)", 0.1), (3, "", 0.0)], "row_id int, cell string, p double").selectExpr("*", "p AS fdr", "'N/A' AS annotation")
    first, second = A.web_table(rows, TB.interactions(lines)).orderBy("rank").collect()
    assert (first["locus_tag"], first["interaction"], first["seed_target"]) == ("g9", None, None)
    assert second["interaction"] == _plain("5'-x  A-3'", " AG", " UC", "3'-A  A-5'", "4 -- 5", "6 -- 7") and second["hybrid_energy"] == "x5"
    assert TB.interactions(lines.limit(0)).count() == 0


def test_labels_and_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "row_id int, label string")
    assert [r["label"] for r in A.unique_labels(df).orderBy("row_id").collect()] == ["a", "a_2", "a_2_3", "b"]
    p = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, None), (4, 0.2)], "row_id int, p double")
    assert [r["row_id"] for r in A.ordered_by_threshold(p, "p", 0.5).orderBy("place").collect()] == [2, 4, 1, 3]


def test_options_and_input(spark):
    assert RunOptions(cores=0).cores == 1
    assert RunOptions.parse(RunOptions(region="cds", nooi=True).text()) == RunOptions(region="cds", nooi=True)
    for bad in ({"region": "x"}, {"maxbpdist": 200}, {"cop1": True, "cons": 1}, {"cons": 1, "nooi": True}, {"ntup": 10, "ntdown": 10}, {"rcsize": 2}):
        with pytest.raises(ValueError):
            RunOptions(**bad)
    assert [choose_mode(o) for o in (RunOptions(), RunOptions(nooi=True), RunOptions(cons=2), RunOptions(cop1=True))] == ["ooi", "balanced", "ooi_consensus", "v1"]
    seqs = spark.createDataFrame([("NC_000001", "ac"), ("NC_000001", "a-c")], "id string, seq string")
    assert len(check_input(seqs)) == 3


def test_fasta_and_genbank(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nac\ngt\n>y\naa-a\n")
    assert sorted((r["id"], r["seq"]) for r in SQ.read_fasta(spark, str(tmp_path / "a.fa"), keep_gaps=False).collect()) == [("x one", "acgt"), ("y", "aaa")]
    spark.dataSource.register(SQ.FastaSource)
    assert spark.read.format("fasta_records").load(str(tmp_path / "a.fa")).count() == 2
    gb = 'LOCUS       NC_1  20 bp    DNA     circular BCT\nVERSION     NC_1.2\n  ORGANISM  G s\nFEATURES             Location/Qualifiers\n     source          1..20\n     CDS             complement(3..11)\n                     /locus_tag="t1"\n                     /product="a\n                     b"\nORIGIN\n        1 acgtacgtac gtacgtacgt\n//\n'
    (tmp_path / "b.gb").write_text(gb + gb.replace("NC_1", "NC_2"))
    rows = SQ.read_genbank(spark, str(tmp_path / "b.gb")).collect()
    assert [r["replicon"] for r in rows] == ["NC_1", "NC_1", "NC_2", "NC_2"]
    assert rows[1]["product"] == "a b" and rows[1]["strand"] == -1 and rows[0]["seq"] == "acgtacgtacgtacgtacgt" and rows[0]["circular"]
    assert SQ.complete_files(spark, str(tmp_path / "b.gb")).first()["complete"]


def test_newick():
    edges = TB.parse_newick("((a:1,b:2):0.5,c:-3);")
    assert sorted(edges) == [("#1", "#2", 0.5), ("#1", "c", 3.0), ("#2", "a", 1.0), ("#2", "b", 2.0)]


def test_stream_of_hits(spark, tmp_path):
    from rankloom.streaming.intake import best_so_far, read_hit_stream

    cols = list(TB.HIT_COLUMNS)
    def row(**kw):
        return ";".join(str(kw.get(c, "")) for c in cols)

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("\n".join([";".join(cols), row(id1="g", id2="o", E=-1), row(id1="g", id2="o", E=-5, start1=3)]) + "\n")
    q = best_so_far(read_hit_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("best_hits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["E"], r["start1"]) for r in spark.table("best_hits").collect()] == [(-5.0, 3)]


def test_heatmap_values_have_no_java_form(spark):
    import json

    cols = "source string, s_num int, s_max int, feature string, f_num int, f_max int, member int, group_id int, groups int, value double, group_text string"
    rows = [("s", 1, 0, 'f"', 1, 5, 1, 1, 5, v, "t;u") for v in (0.5, 1 / 1025, 1 / 300_000, 1.0)]
    got = [r["json"] for r in A.heatmap_cells(spark.createDataFrame([*rows, rows[0][:9] + (None, None)], cols)).collect()]
    assert [g[g.index('"value":') + 8 : g.index(',"group"')] for g in got[:4]] == ["0.5", "0.000975609756097561", "3.3333333333333333e-06", "1.0"]
    assert [json.loads(g).get("value") for g in got] == [0.5, 1 / 1025, 1 / 300_000, 1.0, None] and json.loads(got[0])["feature"] == 'f"' and "group" not in json.loads(got[4])


def test_homologs_without_pairs(spark):
    """Lists equal the plain ones, also of loci in several clusters, and no join makes the pairs of a cluster."""
    rows = [(c, f"g{i}", (i * 7) % 10) for c in range(3) for i in range(c * 5, c * 5 + 8)] + [(0, "g1", 0), (7, "lone", 1), (8, None, 1), (None, "g1", 1), (9, "g2", None), (9, "g90", 3)]
    df = spark.createDataFrame(rows, "cluster int, locus string, pos int")
    have = [(c, x, -1 if p is None else p) for c, x, p in rows if c is not None and x is not None]
    want = {}
    for locus in {x for _, x, _ in have}:
        first = {}
        for c, other, p in have:
            if other != locus and (c, locus) in {(a, b) for a, b, _ in have}:
                first[other] = min(first.get(other, (c, p)), (c, p))
        if first:
            want[locus] = " ".join(sorted(first, key=lambda o: (first[o], o)))
    for piece in (2, 1000):
        got = A.homologs(df, piece)
        assert {r["locus"]: r["homologs"] for r in got.collect()} == want
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert "lone" not in want and {r["locus"] for r in A.homologs(df).collect()} == set(want)


def test_unique_labels_by_ranges(spark):
    """A label's rows are written by several tasks; rows without a label stay."""
    df = spark.range(400).selectExpr("id AS row_id", "CASE WHEN id < 390 THEN 'a' END AS label")
    got = A.unique_labels(df)
    assert got.where("label is not null").select(F.spark_partition_id()).distinct().count() > 1
    labels = {r["row_id"]: r["label"] for r in got.collect()}
    assert labels == {i: None if i >= 390 else "_".join(["a", *map(str, range(2, i + 2))]) for i in range(400)}


def test_genbank_batches(spark, tmp_path, monkeypatch):
    """Records go to Python a bounded number at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    (tmp_path / "a.gb").write_text("".join(f"LOCUS       NC_{i}  4 bp    DNA     linear BCT\nFEATURES             Location/Qualifiers\n     source          1..4\nORIGIN\n        1 acgt\n//\n" for i in range(25)))
    monkeypatch.setattr(SQ, "RECORDS", 10)
    try:
        spark.conf.set(key, "10000")
        assert SQ.read_genbank(spark, str(tmp_path)).count() == 25
        assert spark.conf.get(key) == "10"
    finally:
        spark.conf.set(key, before)
