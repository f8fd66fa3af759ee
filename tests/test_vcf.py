"""VCF text, alleles, consequences and coordinates on small literal inputs."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from helixframe import dims
from helixframe.functions import parsing as P
from helixframe.operators import coords as C, ranking as RK, vcf as V
from helixframe.plans.coordinates import coding_dims
from helixframe.sources import readers as RD


def lines(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value string")


def test_parse_fields(spark):
    row = "chr13\t100\t.\ta\tg,t\t99\tLowQual\t.\tGT:GQ\t0/1:12\tx"
    got = V.parse_lines(lines(spark, row, "ZZ\t1\t.\tA\tG", "13\tx1\t.\tA\tG", "13\t5\t.\tA", "chrX\t7\t.\tA\tG")).orderBy("id").collect()
    a = got[0]
    assert (a["chrom"], a["pos"], a["ref"], a["alt"], a["genotype"], a["gq"], a["multi_sample"]) == ("13", 100, "A", "G,T", "0/1", 12, True)
    assert len(a["warnings"]) == 2
    assert [r["parsed"] for r in got] == [True, False, False, False, True] and got[4]["chrom"] == "x"


def test_read_vcf_keeps_order_and_drops_headers(spark, tmp_path):
    f = tmp_path / "a.vcf"
    f.write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\n\n" + "".join(f"13\t{i}\t.\tA\tG\n" for i in range(500)))
    (tmp_path / "b.vcf").write_text("not a vcf\nat all\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        raw = RD.read_lines(spark, str(tmp_path / "*.vcf"))
        data = raw.filter(RD.is_data(F.col("value"))).filter(F.col("file").endswith("a.vcf"))
        order = RK.number_rows(data, ["file"], F.col("block"), ["seq"], "line").orderBy("line").collect()
        assert [int(r["value"].split("\t")[1]) for r in order] == list(range(500))
        assert [r["line"] for r in order] == list(range(1, 501))
        check = {r["file"].rsplit("/", 1)[1]: r for r in RD.vcf_format_check(raw).collect()}
        assert check["a.vcf"]["format_ok"] and check["a.vcf"]["n_data"] == 500 and check["a.vcf"]["n_header"] == 2
        assert not check["b.vcf"]["format_ok"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_duplicates_first_row_wins_per_file(spark):
    df = spark.createDataFrame([("f", 1, 0, "13\t5\t.\tA\tG,*"), ("f", 2, 0, "chr13\t5\t.\ta\tg"), ("g", 1, 0, "13\t5\t.\tA\tG")], "file string, id int, z int, value string")
    out = V.dedup_alleles(V.explode_alleles(V.parse_lines(df)), ["file"], ["file", "id", "allele"]).orderBy("file", "id", "allele").collect()
    assert [r["skip"] for r in out] == [None, "Unsupported allele type: *", "Duplicate variant", None]


def test_consequences(spark):
    coding, zones = coding_dims(spark)
    gene = coding.filter("gene = 'BRCA2'").orderBy("cdna_pos").select("cdna_pos", "genomic_pos", "codon", "codon_offset").limit(400).collect()
    at = {r["cdna_pos"]: r for r in gene}
    base = at[10]["codon"][at[10]["codon_offset"]]
    wrong = next(b for b in "ACGT" if b != base)
    end = at[150]["genomic_pos"]
    rows = [("13", at[10]["genomic_pos"], base, base + "TT"), ("13", at[10]["genomic_pos"], base, base + "TTT"), ("17", 1, "A", "G"), ("13", end + 1, "A", "G"),
            ("13", end + 5, "A", "G"), ("13", end + 20, "A", "G"), ("13", at[10]["genomic_pos"], wrong, base), ("13", 5, "N", "A")]
    df = spark.createDataFrame([(i, "BRCA2", *r) for i, r in enumerate(rows)], "id int, gene string, chrom string, pos bigint, ref string, alt string")
    d = {n: dims.dim(spark, n) for n in ("genes", "domains", "codons")}
    out = V.apply_outcomes(V.consequences(df, d["genes"], d["domains"], coding, zones, d["codons"]), F.lit(0.5)).orderBy("id").collect()
    assert [r["variant_type"] for r in out] == ["frameshift", "inframe_indel", None, "splice_canonical", "splice_near", None, None, None]
    assert out[2]["reason"] == "Not on chr13" and out[5]["reason"] == "Not in BRCA2 CDS" and out[6]["reason"].startswith("Ref mismatch")
    assert out[7]["reason"] == "Invalid alleles"
    strict = V.consequences(df.limit(100).withColumn("pos", F.lit(5).cast("bigint")), d["genes"], d["domains"], coding, zones, d["codons"], strict_region=True)
    assert strict.filter("id = 0").first()["reason"] == "Not in BRCA2 region"


def test_splice_invariants(spark):
    coding, zones = coding_dims(spark)
    assert zones.join(coding, ["gene", "genomic_pos"]).count() == 0
    assert zones.filter("(zone = 'canonical') <> (distance <= 2)").count() == 0
    assert zones.groupBy("gene", "genomic_pos").count().filter("count > 1").count() == 0


def test_minus_strand_map(spark):
    ex = spark.createDataFrame([("t", "-", 100, 104, 102, 212), ("t", "-", 200, 210, 102, 212), ("t", "-", 300, 310, 102, 212)],
                               "tx string, strand string, exon_start bigint, exon_end bigint, cds_start bigint, cds_end bigint")
    m = [r["genomic_pos"] for r in C.cdna_map(ex, ["tx"]).orderBy("cdna_pos").collect()]
    assert m == list(range(210, 199, -1)) + [104, 103, 102]


def test_zones_send_no_base_map_to_tasks(spark):
    """The exons' table is small whatever its map's size: nothing of the map may be broadcast or joined base by base."""
    rows = [(f"t{i}", "+-"[i % 2], 100 + 60 * k, 119 + 60 * k, 105, 290) for i in range(40) for k in range(4)]
    ex = spark.createDataFrame(rows, "tx string, strand string, exon_start bigint, exon_end bigint, cds_start bigint, cds_end bigint")
    full, plain = C.cdna_map(ex, ["tx"], ["cdna_before"]), C.cdna_map(ex, ["tx"])
    edges, zones = C.boundaries_from_map(full, ["tx"]), C.splice_zones(C.boundaries_from_map(full, ["tx"]), full, ["tx"])
    assert sorted(edges.collect()) == sorted(C.boundaries_from_map(plain, ["tx"]).collect()) and edges.count() == 120
    assert sorted(zones.collect()) == sorted(C.splice_zones(C.boundaries_from_map(plain, ["tx"]), plain, ["tx"]).collect()) and zones.count() == 120 * 16
    assert "Broadcast" not in zones._jdf.queryExecution().executedPlan().toString()
    folded = C.coding_runs(full, ["tx"])
    assert folded.count() == 160 and plain.count() == 40 * 66


def test_base_maps_are_dealt_by_bases(spark):
    ex = spark.range(30).selectExpr("id AS tx", "'+' AS strand", "1L AS exon_start", "100000L AS exon_end", "1L AS cds_start", "100000L AS cds_end")
    parts = C.cdna_map(ex, ["tx"]).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 3_000_000 and len(parts) > 1


def test_text_parsers(spark):
    df = spark.createDataFrame([("p.Arg5His", "M1361L", ".;NA;0.5", "-1;7", "13-5-A-G"), ("p.Arg5*", "A1V:G2S", "1e-3", "x", "99-5-A-G"), ("none", "K7K", ".", "-1", "13-5-A")],
                               "h string, t string, s string, p string, g string")
    out = df.select(P.amino_change(F.col("h")).alias("h"), P.mutant_token(F.col("t")).alias("t"), P.first_score(F.col("s")).alias("s"), P.first_position(F.col("p")).alias("p"),
                    P.genomic_id(F.col("g")).alias("g")).collect()
    assert tuple(out[0]["h"]) == ("Arg", 5, "His") and out[1]["h"]["alt"] == "Ter" and out[2]["h"] is None
    assert tuple(out[0]["t"]) == ("M", 1361, "L") and out[1]["t"] is None and out[2]["t"] is None
    assert [r["s"] for r in out] == [0.5, 0.001, None] and [r["p"] for r in out] == [7, None, None]
    assert [r["g"]["error"] for r in out] == [None, "Invalid chromosome in variant", "Expected format: chr-pos-ref-alt"]


def test_duplicates_are_marked_in_one_pass(spark):
    """Rows are read once: no join of the alleles with their own first ones."""
    df = spark.createDataFrame([("f", 2, "13\t5\t.\tA\tG"), ("f", 1, "13\t5\t.\tA\tG"), ("f", 1, "13\t5\t.\tA\tG"), ("f", 3, "13\t5\t.\tA\t*"), ("f", 4, "13\t6\t.\tA\tG"),
                                (None, 5, "13\t5\t.\tA\tG"), ("h", None, "13\t5\t.\tA\tG"), ("h", 6, "13\t5\t.\tA\tG")], "file string, id int, value string")
    out = V.dedup_alleles(V.explode_alleles(V.parse_lines(df)), ["file"], ["file", "id", "allele"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    again, unsupported = "Duplicate variant", "Unsupported allele type: *"
    rows = [(r["file"], r["id"], r["skip"]) for r in out.collect()]
    assert sorted(rows, key=str) == sorted([("f", 1, None), ("f", 1, again), ("f", 2, again), ("f", 3, unsupported), ("f", 4, None), (None, 5, again), ("h", None, again), ("h", 6, again)], key=str)


def test_malformed_lines_go_along_as_one_reject(spark):
    """Rejects of both kinds leave one pass over the lines, with no place for what could not be read."""
    df = lines(spark, "13\t5\t.\tA\tG,*", "ZZ\t7\t.\tA\tG,T", "13\tx\t.\tA\tG", "short", None)
    out = V.explode_alleles(V.parse_lines(df), malformed=True)
    got = {(r["id"], r["allele"]): (r["pos"], r["skip"]) for r in out.collect()}
    assert got == {(0, 0): (5, None), (0, 1): (5, "Unsupported allele type: *"), **{(i, 0): (None, "Parse error") for i in (1, 2, 3, 4)}}
    plan = entry.queries()["vcf_skip_counts"](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_compound_het_works_its_rows_out_once(spark):
    df = spark.createDataFrame([("g", 1, "0/1", "a"), ("g", 2, None, "b"), ("g", 3, "1/1", "c"), ("h", 4, "0|1", "d"), ("h", 5, "1/1", "e")], "gene string, id int, genotype string, d string")
    out = V.compound_het(df, ["gene"], ["id"], F.upper("d"))
    assert "LogicalRDD" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "upper" not in plan
    assert [tuple(r) for r in out.collect()] == [("g", 3, 2, True, ["A", "B"])]
