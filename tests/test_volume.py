"""How much queries shuffle, spill and write, beside the reads themselves."""

import pyarrow as pa
import pytest
from pyspark import TaskContext

from helixframe.operators import overlap
from helixframe.plans import catalog
from helixframe.sources import fastx, ranges


def _moved(spark) -> int:
    """Bytes that all stages until now have shuffled, spilled and written."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()).iterator()
    out = 0
    while stages.hasNext():
        s = stages.next()
        out += s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes()
    return out


def _moves(spark, sf_dir, name) -> int:
    catalog.QUERIES["reads_scan"](spark, sf_dir).count()
    before = _moved(spark)
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return _moved(spark) - before


def test_reads_are_stored_without_what_follows_from_them(spark, sf_dir):
    """Contigs and qualities follow from numbers; all queries write the reads first."""
    rows = catalog.reads(spark, sf_dir)
    assert {"contig", "qual", "seq"} <= set(rows.columns) and not {"contig", "qual"} & set(spark.read.parquet(*rows.inputFiles()).columns)


def test_like_anchors_lie_side_by_side(spark, sf_dir):
    """Before they are shuffled, so that texts with one anchor, which are mostly alike, take few bytes."""
    reads = catalog.reads(spark, sf_dir).where("ordinal < 500").coalesce(1)
    windows = overlap.middle_windows(60)
    for rows in (overlap.anchored_texts(reads.select(overlap.F.col("ordinal").alias("a"), overlap.F.col("seq").alias("x")), windows, 60), overlap.anchored_windows(reads, windows).where("dict = 0")):
        keys = [r.key % 2**64 for r in rows.select("key").collect()]
        assert len(keys) > 400 and keys == sorted(keys)


def test_greedy_clusters_move_few_probes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(overlap, "ONE_WINDOW_BELOW", 10)
    assert _moves(spark, sf_dir, "greedy_clusters") < 6_000_000
    # copies of one read are no pairs of each other
    copies = spark.range(200_000).selectExpr("id as ordinal", "repeat('ACGTTGCATTAGC', 5) as seq").withColumn("seq", overlap.F.substring("seq", 1, 60))
    got = overlap.nearest_before(copies, overlap.middle_windows(60), overlap.shifts(60))
    assert got.groupBy("before", "shift", "orientation", "distance").count().collect() == [(0, 0, "d", 0, 199_999)]


def test_absorb_candidates_look_by_anchors(spark, sf_dir):
    """A contig has a row for each anchor, not for each place, window and strand, and no more of its bases than a read may need."""
    windows = overlap.head_windows(60)
    contigs = catalog.reads(spark, sf_dir).select(overlap.F.col("contig_id").alias("a"), overlap.F.col("contig").alias("x")).distinct()
    rows = overlap.anchored_texts(contigs, windows, 60)
    assert rows.count() < 0.15 * contigs.count() * 2 * sum(96 - b for _, b in windows)
    long = spark.range(1).selectExpr("id as a", "repeat('ACGTTGCATTAGCCA', 1000) as x")
    assert overlap.anchored_texts(long, windows, 60).where("length(piece) > 136").count() == 0


def test_shift_candidates_move_each_key_once(spark, sf_dir):
    assert _moves(spark, sf_dir, "shift_candidates") < 2_000_000


@pytest.mark.parametrize("name, most", [("contig_consensus", 500_000), ("contig_offsets", 500_000), ("contig_fetch", 1_300_000), ("overlap_roundtrip", 1_600_000), ("id_codes", 300_000), ("id_decode", 300_000)])
def test_votes_and_names_move_little(spark, sf_dir, name, most):
    assert _moves(spark, sf_dir, name) < most


@pytest.mark.parametrize("name", ["archive_transforms", "archive_unordered", "archive_roundtrip"])
def test_archives_shuffle_reads_once(spark, sf_dir, name, monkeypatch):
    """Digests, names and blocks follow from one order of the reads; a further one would be by lane and place."""
    frame = type(spark.range(0))
    ranges, whole = [], frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: ranges.append(self.columns) or whole(self, *a))
    catalog.QUERIES[name](spark, sf_dir).count()
    assert sum({"seq", "qual"} <= set(c) for c in ranges) == 1


@pytest.mark.parametrize("name", ["archive_transforms", "archive_unordered", "archive_roundtrip", "overlap_roundtrip"])
def test_reads_are_shuffled_in_packed_pieces(spark, sf_dir, name, monkeypatch):
    frame = type(spark.range(0))
    kinds, whole = [], frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: kinds.append(dict(self.dtypes)) or whole(self, *a))
    catalog.QUERIES[name](spark, sf_dir).count()
    assert [(k["seq"], k["qual"]) for k in kinds if {"seq", "qual"} <= set(k)] == [("binary", "binary")]


def test_chains_shuffle_rows_once(spark, sf_dir):
    keyed = overlap.keyed(catalog.reads(spark, sf_dir), overlap.head_windows(60))
    before = _moved(spark)
    overlap.chains(keyed).write.format("noop").mode("overwrite").save()
    assert _moved(spark) - before < 800_000
    assert "row_number" not in overlap.order.with_ordinal(keyed, [overlap.F.col("ordinal")], "n")._jdf.queryExecution().toString()


@pytest.mark.parametrize("compression", ["none", "gzip", "bgzf"])
def test_ranges_are_read_by_many_tasks(spark, tmp_path, compression):
    """Rows of ranges are small, but the work isn't: adaptive execution must not join them to one task."""
    path = f"file://{tmp_path}/x"
    records = spark.range(4000).selectExpr("id as ordinal", "concat('@r', id, '\nACGT\n+\nIIII') as record")
    for i in range(4):
        fastx.write(records, f"{path}/{i}", compression)
    cut = ranges.ranges(spark, f"{path}/*", 1 << 12)

    def task(row, f):
        yield pa.RecordBatch.from_pylist([{"task": TaskContext.get().partitionId(), "size": row["end"] - row["start"]}], schema=pa.schema([("task", pa.int32()), ("size", pa.int64())]))

    rows = ranges.each(cut, "task int, size long", task).collect()
    assert len(rows) == cut.count() and len({r.task for r in rows}) == 4


def test_kmers_move_as_codes(spark, sf_dir):
    assert _moves(spark, sf_dir, "kmer_label_hits") < 350_000


def test_assay_reads_each_lane_once_for_rates_and_once_for_kmers(spark, sf_dir):
    plan = catalog.QUERIES["assay_detail"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # two lanes twice, and the contigs
    assert plan.count("Relation [") <= 5


def test_members_move_only_ends(spark, sf_dir):
    assert _moves(spark, sf_dir, "integrity_root") < 100_000


@pytest.mark.parametrize("name, most", [("fastq_scan", 1_000_000), ("gzip_scan", 450_000), ("bgzf_roundtrip", 450_000), ("file_kinds", 1_700_000)])
def test_files_are_written_without_a_shuffle(spark, sf_dir, name, most):
    assert _moves(spark, sf_dir, name) < most


def test_mates_move_in_packed_pieces(spark, sf_dir):
    assert _moves(spark, sf_dir, "mate_join") < 800_000
