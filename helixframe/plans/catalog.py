"""Registered queries of the read operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import ids, quality, seq, tails
from helixframe.operators import consensus, integrity, order, overlap, packing, pairing, stats
from helixframe.plans import archive
from helixframe.scratch import materialize, scratch_path
from helixframe.sources import fastx
from helixframe.sources.derived import READS_SQL, contigs, reads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, more: str = ""):
    """Registers a function of (reads) under its name. ``more``: further names of the WITH clause that makes the reads."""

    def register(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(reads(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = READS_SQL + (",\n" + more if more else "") + "\n" + sql
        return f

    return register


AD0, AD1 = tails.ADAPTERS

# -- variants of the reads, as both engines make them --------------------------------------------------------


def odd_letters(r: DataFrame) -> DataFrame:
    return r.withColumn("seq", F.when(F.col("ordinal") % 11 == 0, F.lower("seq")).when(F.col("ordinal") % 13 == 0, F.concat("seq", F.lit("X"))).otherwise(F.col("seq")))


ODD = "odd AS (SELECT ordinal, CASE WHEN ordinal % 11 = 0 THEN lower(seq) WHEN ordinal % 13 = 0 THEN seq || 'X' ELSE seq END AS seq FROM reads)"


def tailed(r: DataFrame) -> DataFrame:
    n = (21 + F.col("ordinal") % 9).cast("int")
    return r.withColumn("seq", F.when(F.col("ordinal") % 7 == 0, F.concat("seq", F.repeat(F.lit("A"), n))).when(F.col("ordinal") % 7 == 1, F.concat("seq", F.repeat(F.lit("t"), F.lit(25)))).when(F.col("ordinal") % 7 == 2, F.concat("seq", F.lit("G" + "A" * 20))).otherwise(F.col("seq")))


TAILED = """tailed AS (SELECT ordinal, id, CASE ordinal % 7 WHEN 0 THEN seq || repeat('A', (21 + ordinal % 9)::INT) WHEN 1 THEN seq || repeat('t', 25) WHEN 2 THEN seq || 'G' || repeat('A', 20) ELSE seq END AS seq FROM reads),
tail AS (SELECT *, regexp_extract(upper(seq), '(A{21,}|T{21,})$', 1) AS t FROM tailed)"""


def adapted(r: DataFrame) -> DataFrame:
    n = (10 + F.col("ordinal") % 10).cast("int")
    return r.withColumn("seq", F.when(F.col("ordinal") % 6 == 0, F.concat("seq", F.substring(F.lit(AD0), F.lit(1), n))).when(F.col("ordinal") % 6 == 1, F.concat("seq", F.lower(F.substring(F.lit(AD1), F.lit(1), n)))).otherwise(F.col("seq")))


_ADAPTED = f"adapted AS (SELECT ordinal, CASE ordinal % 6 WHEN 0 THEN seq || substr('{AD0}', 1, (10 + ordinal % 10)::INT) WHEN 1 THEN seq || lower(substr('{AD1}', 1, (10 + ordinal % 10)::INT)) ELSE seq END AS seq FROM reads)"
_OVERLAP = lambda a: f"coalesce(list_max(list_filter(range({tails.LEAST_OVERLAP}, {len(a) + 1}), lambda n: ends_with(upper(seq), substr('{a}', 1, n::INT)))), 0)"
ADAPTED = f"""{_ADAPTED},
found AS (SELECT *, {_OVERLAP(AD0)} AS n0, {_OVERLAP(AD1)} AS n1 FROM adapted),
adapter AS (SELECT ordinal, seq, CASE WHEN n0 > 0 THEN 0 WHEN n1 > 0 THEN 1 ELSE -1 END AS adapter, (CASE WHEN n0 > 0 THEN n0 ELSE n1 END)::INT AS overlap FROM found)"""


def lanes(r: DataFrame) -> DataFrame:
    """R1 with tails on some reads, R2 from the contig's other end."""
    r1 = tailed(r).select(F.lit("R1").alias("lane"), "ordinal", "id", "seq", "qual")
    name = F.when(F.col("ordinal") % 5 == 0, F.concat(F.col("id"), F.lit(" CB:Z:AC"))).when(F.col("ordinal") % 5 == 1, F.concat(F.col("id"), F.lit(" UMI:GT"))).otherwise(F.col("id"))
    return r1.unionByName(r.select(F.lit("R2").alias("lane"), "ordinal", name.alias("id"), seq.reverse_complement(F.substring("contig", 41, 50)).alias("seq"), F.substring("qual", 1, 50).alias("qual")))


_RC = lambda s: f"reverse(translate({s}, 'ACGTN', 'TGCAN'))"
LANES = TAILED + f""",
lanes AS (SELECT 'R1' AS lane, t.ordinal, t.id, t.seq, r.qual FROM tailed t JOIN reads r USING (ordinal) UNION ALL
  SELECT 'R2', ordinal, CASE ordinal % 5 WHEN 0 THEN id || ' CB:Z:AC' WHEN 1 THEN id || ' UMI:GT' ELSE id END, {_RC('substr(contig, 41, 50)')}, substr(qual, 1, 50) FROM reads)"""

# -- scans and scalar functions --------------------------------------------------------------------------------


@query("SELECT ordinal, id, seq, qual FROM reads")
def reads_scan(r):
    return r.select("ordinal", "id", "seq", "qual")


@query("SELECT ordinal, id, seq FROM reads WHERE ordinal < 10000")
def reads_first_n(r):
    return r.where(F.col("ordinal") < 10000).select("ordinal", "id", "seq")


@query("SELECT ordinal, contains(seq, 'N') AS has_n FROM reads")
def has_n(r):
    return r.select("ordinal", seq.has_n(F.col("seq")).alias("has_n"))


@query("SELECT ordinal, regexp_matches(seq, '[^ACGTNacgtn\r\n ]') AS odd FROM odd", ODD)
def alphabet_check(r):
    return odd_letters(r).select("ordinal", seq.has_non_acgtn(F.col("seq")).alias("odd"))


@query("SELECT ordinal, upper(seq) AS seq FROM odd", ODD)
def upper_bases(r):
    return odd_letters(r).select("ordinal", seq.upper_bases(F.col("seq")).alias("seq"))


@query(f"SELECT ordinal, {_RC('seq')} AS rc FROM reads")
def revcomp(r):
    return r.select("ordinal", seq.reverse_complement(F.col("seq")).alias("rc"))


_KMERS = "k AS (SELECT ordinal, w FROM (SELECT ordinal, substr(seq, i::INT, 17) AS w FROM (SELECT ordinal, seq, unnest(range(1, length(seq) - 15, 10)) AS i FROM reads)) WHERE NOT regexp_matches(w, '[^ACGT]'))"


@query("SELECT ordinal, w AS kmer FROM k", _KMERS)
def kmers_strided(r):
    return r.select("ordinal", F.explode(seq.kmers(F.col("seq"), 10)).alias("kmer"))


@query(f"SELECT least(w, {_RC('w')}) AS kmer, count(*) AS n FROM k GROUP BY 1", _KMERS)
def kmers_canonical(r):
    return r.select(F.explode(seq.kmers(F.col("seq"), 10)).alias("w")).groupBy(seq.canonical(F.col("w")).alias("kmer")).agg(F.count("*").alias("n"))


_SCALE = "!\"#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJ"
_BINNED = "".join(chr(33 + (q if q < 2 else 6 if q < 10 else 15 if q < 20 else 22 if q < 25 else 27 if q < 30 else 33 if q < 35 else 37 if q < 40 else 40)) for q in range(42)).replace("'", "''")


@query(f"SELECT ordinal, translate(qual, '{_SCALE}', '{_BINNED}') AS qual FROM reads")
def quality_illumina8(r):
    return r.select("ordinal", quality.illumina8(F.col("qual")).alias("qual"))


@query("SELECT ordinal, array_to_string(list_transform(string_split(qual, ''), lambda c: CASE WHEN ascii(c) < 53 THEN chr(39) ELSE chr(73) END), '') AS qual FROM reads")
def quality_binary(r):
    return r.select("ordinal", quality.binary(F.col("qual"), 20, 40, 6).alias("qual"))


@query("SELECT ordinal, substr(seq, 1, length(seq) - length(t)) AS seq, length(t)::INT AS len, substr(t, 1, 1) AS base FROM tail", TAILED)
def polyat_split(r):
    i = tails.polyat_info(F.col("seq"))
    return tailed(r).select("ordinal", tails.strip(F.col("seq"), i["len"]).alias("seq"), i["len"].alias("len"), i["base"].alias("base"))


@query("SELECT ordinal, CASE WHEN t = '' THEN seq ELSE substr(seq, 1, length(seq) - length(t)) || t END AS seq FROM tail", TAILED)
def polyat_restore(r):
    cut = tailed(r).withColumn("info", tails.polyat_info(F.col("seq"))).select("ordinal", tails.strip(F.col("seq"), F.col("info.len")).alias("seq"), "info")
    return cut.select("ordinal", tails.polyat_restore(F.col("seq"), F.col("info")).alias("seq"))


@query("SELECT ordinal, substr(seq, 1, length(seq) - overlap) AS seq, adapter, overlap FROM adapter", ADAPTED)
def adapter_split(r):
    i = tails.adapter_info(F.col("seq"))
    return adapted(r).select("ordinal", tails.strip(F.col("seq"), i["overlap"]).alias("seq"), i["adapter"].alias("adapter"), i["overlap"].alias("overlap"))


@query("SELECT ordinal, upper(seq) AS seq FROM adapted", _ADAPTED)
def adapter_restore(r):
    cut = adapted(r).withColumn("info", tails.adapter_info(F.col("seq"))).select("ordinal", tails.strip(F.col("seq"), F.col("info.overlap")).alias("seq"), "info")
    return cut.select("ordinal", F.upper(tails.adapter_restore(F.col("seq"), F.col("info"))).alias("seq"))


@query("SELECT count(*) AS eligible, sum(overlap)::BIGINT AS stripped, count(*) >= 1024 AND sum(overlap) >= count(*) AS active FROM adapter WHERE NOT contains(seq, 'N')", ADAPTED)
def adapter_activation(r):
    return stats.adapter_activation(adapted(r))


@query("SELECT ordinal, substr(seq, 1, 16) AS cb_seq, substr(qual, 1, 16) AS cb_qual, substr(seq, 17) AS seq, substr(qual, 17) AS qual FROM reads")
def barcode_split(r):
    return r.select("ordinal", tails.barcode(F.col("seq"), 16).alias("cb_seq"), tails.barcode(F.col("qual"), 16).alias("cb_qual"), tails.after_barcode(F.col("seq"), 16).alias("seq"), tails.after_barcode(F.col("qual"), 16).alias("qual"))


@query("SELECT ordinal, seq, qual FROM reads")
def barcode_rejoin(r):
    return barcode_split(r).select("ordinal", F.concat("cb_seq", "seq").alias("seq"), F.concat("cb_qual", "qual").alias("qual"))


@query("SELECT ordinal, contains(id, 'CB:Z:') AS cb, contains(id, 'UB:Z:') OR contains(id, 'UR:Z:') OR contains(id, 'UMI:') AS umi FROM lanes WHERE lane = 'R2'", LANES)
def header_tags(r):
    return lanes(r).where("lane = 'R2'").select("ordinal", ids.has_barcode_tag(F.col("id")).alias("cb"), ids.has_umi_tag(F.col("id")).alias("umi"))


# -- files -----------------------------------------------------------------------------------------------------


def _file(r: DataFrame, compression: str, form: str = "fastq") -> str:
    """Files of the reads in the shared folder."""
    path = scratch_path(r.sparkSession, "files")
    record = fastx.fastq(F.col("id"), F.col("seq"), F.col("qual")) if form == "fastq" else fastx.fasta(F.col("id"), F.col("seq"))
    fastx.write(r.select("ordinal", record.alias("record")), path, compression, in_place=True)
    return path


@query("SELECT ordinal, id, seq, '+' AS plus, qual, false AS crlf FROM reads")
def fastq_scan(r):
    """FASTQ files, written and read in ranges."""
    return fastx.read(r.sparkSession, _file(r, "none"), "fastq", across=True, size=1 << 20).drop("file")


@query("SELECT ordinal, id, seq FROM reads")
def fasta_scan(r):
    return fastx.read(r.sparkSession, _file(r, "none", "fasta"), "fasta", across=True, size=1 << 20).select("ordinal", "id", "seq")


@query("SELECT ordinal, id, seq, qual FROM reads")
def gzip_scan(r):
    return fastx.read(r.sparkSession, _file(r, "gzip"), "fastq", across=True).select("ordinal", "id", "seq", "qual")


@query("SELECT ordinal, id, seq, qual FROM reads")
def bgzf_roundtrip(r):
    """Block gzip, written by tasks and read in ranges of whole blocks."""
    return fastx.read(r.sparkSession, _file(r, "bgzf"), "fastq", across=True, size=1 << 18).select("ordinal", "id", "seq", "qual")


@query("SELECT v.kind, (SELECT sum(length(id) + 2 * length(seq) + 5) FROM reads)::BIGINT AS text_bytes, v.profile, v.origin FROM (VALUES ('plain', NULL, NULL), ('gzip', 'DEFAULT/OTHER', 'Programmatic (No filename)'), ('bgzf', 'BGZF (Default)', 'htslib/samtools/clib')) v(kind, profile, origin)")
def file_kinds(r):
    """What the first bytes of files say about them, and the bytes of their text."""
    out = None
    for compression in ("none", "gzip", "bgzf"):
        path = _file(r, compression)
        one = fastx.gzip_headers(r.sparkSession, path).join(fastx.total_bytes(r.sparkSession, path), "file")
        out = one if out is None else out.unionByName(one)
    b, known = F.col("kind") == "bgzf", F.col("kind") != "plain"
    rows = out.withColumns({"profile": F.when(known, integrity.gzip_profile(b, F.col("xfl"))), "origin": F.when(known, integrity.gzip_origin(b, F.col("mtime"), F.col("os"), F.col("flg")))})
    return rows.groupBy("kind", "profile", "origin").agg(F.sum("text_bytes").alias("text_bytes"))


# -- names and pairs -------------------------------------------------------------------------------------------


@query("SELECT ordinal, '@' || (ordinal + 1) || '/1' AS id_1, '@' || (ordinal + 1) || '/2' AS id_2 FROM reads")
def synthetic_ids(r):
    return r.select("ordinal", ids.synthetic(F.col("ordinal"), 1).alias("id_1"), ids.synthetic(F.col("ordinal"), 2).alias("id_2"))


_TOKENS = "tok AS (SELECT ordinal, regexp_extract_all(id, '([0-9A-Za-z]+|[^0-9A-Za-z]+)', 1) AS ts FROM reads), each AS (SELECT ordinal, unnest(range(1, len(ts) + 1)) AS i, ts FROM tok)"


@query("SELECT ordinal, (i - 1)::INT AS place, ts[i] AS token FROM each", _TOKENS)
def id_tokens(r):
    return r.select("ordinal", F.posexplode(ids.tokens(F.col("id"))).alias("place", "token"))


@query("SELECT ordinal, v - lag(v) OVER (ORDER BY ordinal) AS delta FROM (SELECT ordinal, CASE WHEN regexp_matches(ts[4], '^(0|[1-9][0-9]{0,8})$') THEN ts[4]::BIGINT END AS v FROM tok)", _TOKENS.split(", each")[0])
def id_numeric_delta(r):
    rows = r.select("ordinal", ids.numeric(F.get(ids.tokens(F.col("id")), F.lit(3))).alias("v"))
    # the row before by an equi-join on the place, so that no task orders all rows
    before = rows.select((F.col("ordinal") + 1).alias("ordinal"), F.col("v").alias("u"))
    return rows.join(before, "ordinal", "left").select("ordinal", (F.col("v") - F.col("u")).alias("delta"))


_CODES = """each_token AS (SELECT ordinal, unnest(range(1, len(ts) + 1)) AS i, ts FROM (SELECT ordinal, regexp_extract_all(id, '([0-9A-Za-z]+|[^0-9A-Za-z]+)', 1) AS ts FROM reads)),
prior AS (SELECT ordinal, i, ts[i] AS token, lag(ts[i]) OVER (PARTITION BY ordinal // 10000, i ORDER BY ordinal) AS before FROM each_token),
stepped AS (SELECT *, CASE WHEN regexp_matches(token, '^(0|[1-9][0-9]{0,8})$') AND regexp_matches(before, '^(0|[1-9][0-9]{0,8})$') THEN token::BIGINT - before::BIGINT END AS step FROM prior)"""


@query("SELECT ordinal, (i - 1)::INT AS place, CASE WHEN token = before THEN '=' WHEN step >= 0 THEN '+' || step ELSE '.' || token END AS code FROM stepped", _CODES.replace("token::BIGINT", "try_cast(token AS BIGINT)").replace("before::BIGINT", "try_cast(before AS BIGINT)"))
def id_codes(r):
    return ids.coded(r.select("ordinal", "id"))


@query("SELECT ordinal, id FROM reads")
def id_decode(r):
    return ids.unpacked(materialize(ids.packed(r.select("ordinal", "id")), "codes"))


def named_pairs(r: DataFrame) -> DataFrame:
    a = F.when(F.col("ordinal") % 4 == 0, F.concat(F.lit("@P"), F.col("ordinal").cast("string"), F.lit("/1"))).otherwise(F.col("id"))
    b = F.when(F.col("ordinal") % 4 == 0, F.concat(F.lit("@P"), F.col("ordinal").cast("string"), F.lit("/2"))).when(F.col("ordinal") % 4 == 1, F.col("id")).when(F.col("ordinal") % 4 == 2, F.replace(F.col("id"), F.lit(" 1:"), F.lit(" 2:"))).otherwise(F.concat(F.col("id"), F.lit("x")))
    return r.select("ordinal", a.alias("a"), b.alias("b"))


_PAIRS = """named AS (SELECT ordinal, CASE WHEN ordinal % 4 = 0 THEN '@P' || ordinal || '/1' ELSE id END AS a,
  CASE ordinal % 4 WHEN 0 THEN '@P' || ordinal || '/2' WHEN 1 THEN id WHEN 2 THEN replace(id, ' 1:', ' 2:') ELSE id || 'x' END AS b FROM reads)"""


@query("SELECT ordinal, CASE WHEN right(a, 1) = '1' AND b = left(a, length(a) - 1) || '2' THEN 1 WHEN a = b THEN 2 WHEN contains(a, ' 1:') AND b = regexp_replace(a, ' 1:', ' 2:') THEN 3 ELSE 0 END AS code FROM named", _PAIRS)
def pair_code(r):
    return named_pairs(r).select("ordinal", ids.pair_code(F.col("a"), F.col("b")).alias("code"))


@query("SELECT ordinal, CASE WHEN ordinal % 4 < 3 THEN b END AS b FROM named", _PAIRS)
def mate_id_rebuild(r):
    return named_pairs(r).select("ordinal", ids.mate_name(F.col("a"), ids.pair_code(F.col("a"), F.col("b"))).alias("b"))


def indexed(r: DataFrame) -> DataFrame:
    i1 = r.select("ordinal", F.when(F.col("ordinal") % 3 == 0, F.substring("contig", 1, 7)).otherwise(F.substring("contig", 1, 8)).alias("i1"))
    return r.select("ordinal", "id").join(i1, "ordinal")


_INDEXED = "idx AS (SELECT ordinal, id, CASE WHEN ordinal % 3 = 0 THEN substr(contig, 1, 7) ELSE substr(contig, 1, 8) END AS i1 FROM reads)"


@query("SELECT ordinal, CASE WHEN ends_with(id, ':' || i1) THEN substr(id, 1, length(id) - length(i1)) ELSE id END AS id FROM idx", _INDEXED)
def index_suffix_split(r):
    return indexed(r).select("ordinal", ids.strip_index(F.col("id"), ids.index_suffix(F.col("i1"))).alias("id"))


@query("SELECT ordinal, id FROM reads")
def index_suffix_restore(r):
    rows = indexed(r)
    cut = rows.select("ordinal", "i1", ids.strip_index(F.col("id"), F.col("i1")).alias("id"))
    return cut.select("ordinal", ids.restore_index(F.col("id"), F.col("i1")).alias("id"))


@query("SELECT a.ordinal, a.id AS id_1, a.seq AS seq_1, a.qual AS qual_1, b.id AS id_2, b.seq AS seq_2, b.qual AS qual_2 FROM lanes a JOIN lanes b ON a.ordinal = b.ordinal AND a.lane = 'R1' AND b.lane = 'R2'", LANES)
def mate_join(r):
    both = lanes(r)
    return pairing.mates(both.where("lane = 'R1'"), both.where("lane = 'R2'"))


@query("SELECT ordinal AS old, n - 1 - ordinal AS new FROM reads, (SELECT count(*) AS n FROM reads) UNION ALL SELECT ordinal + n, 2 * n - 1 - ordinal FROM reads, (SELECT count(*) AS n FROM reads)")
def mate_order_follow(r):
    n = r.count()
    return pairing.follow(r.select(F.col("ordinal").alias("old"), (n - 1 - F.col("ordinal")).alias("new")), n)


_MATES = "m AS (SELECT ordinal, ordinal % 5 <> 4 AS a1, ordinal % 7 <> 6 AS a2, (CASE WHEN ordinal % 3 = 0 THEN 40 - pos WHEN ordinal % 3 = 1 THEN -pos - 1 ELSE 32767 + pos END)::BIGINT AS d FROM reads)"


@query("SELECT ordinal, CASE WHEN a1 AND a2 AND d BETWEEN 0 AND 32766 THEN 0 WHEN a1 AND a2 THEN 1 WHEN a1 THEN 3 WHEN a2 THEN 4 ELSE 2 END AS flag FROM m", _MATES)
def mate_flag(r):
    d = F.when(F.col("ordinal") % 3 == 0, 40 - F.col("pos")).when(F.col("ordinal") % 3 == 1, -F.col("pos") - 1).otherwise(32767 + F.col("pos"))
    return r.select("ordinal", pairing.mate_flag(F.col("ordinal") % 5 != 4, F.col("ordinal") % 7 != 6, d).alias("flag"))


@query("SELECT (c - 1 - ordinal) AS ordinal, qual FROM reads, (SELECT count(*) AS c FROM reads)")
def permuted_qualities(r):
    n = r.count()
    return pairing.reordered(r.select("ordinal", "qual"), r.select(F.col("ordinal").alias("old"), (n - 1 - F.col("ordinal")).alias("new")))


@query("SELECT seq FROM reads")
def strip_columns(r):
    return r.drop("id", "qual", "ordinal", "contig", "contig_id", "pos")


# -- statistics and the assay ----------------------------------------------------------------------------------


@query("SELECT count(*) AS num_reads, count(*) FILTER (NOT contains(seq, 'N')) AS num_clean, max(length(seq))::BIGINT AS max_len, bool_or(regexp_matches(seq, '[^ACGTNacgtn\r\n ]')) AS any_non_acgtn FROM odd", ODD)
def read_stats(r):
    return stats.read_stats(odd_letters(r))


@query("SELECT max(length(seq)) > 511 OR bool_or(regexp_matches(seq, '[^ACGTNacgtn\r\n ]')) AS long_mode FROM odd", ODD)
def prescan(r):
    return stats.read_stats(odd_letters(r)).select(((F.col("max_len") > 511) | F.col("any_non_acgtn")).alias("long_mode"))


_COUNT = ", ".join(f"sum(length(seq) - length(replace(upper(seq), '{b}', '')))::BIGINT AS n_{b.lower()}" for b in "ACGT")
_LANE = f"""bases AS (SELECT lane, {_COUNT} FROM lanes GROUP BY lane),
rates AS (SELECT lane, count(*) AS num_reads, avg(CASE WHEN regexp_matches(upper(seq), '(A{{21,}}|T{{21,}})$') THEN 1.0::DOUBLE ELSE 0 END) AS polyat_rate,
  avg(CASE WHEN greatest({_OVERLAP(AD0)}, {_OVERLAP(AD1)}) > 0 THEN 1.0::DOUBLE ELSE 0 END) AS adapter_rate,
  avg(CASE WHEN contains(id, 'CB:Z:') THEN 1.0::DOUBLE ELSE 0 END) AS barcode_rate, avg(CASE WHEN regexp_matches(id, 'UB:Z:|UR:Z:|UMI:') THEN 1.0::DOUBLE ELSE 0 END) AS umi_rate FROM lanes GROUP BY lane),
medians AS (SELECT lane, length(seq)::BIGINT AS median FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY length(seq)) AS k, count(*) OVER (PARTITION BY lane) AS n FROM lanes) WHERE k = n // 2 + 1)"""


@query("SELECT * FROM bases", LANES + ",\n" + _LANE)
def base_composition(r):
    return stats.composition(lanes(r))


@query("SELECT * FROM rates", LANES + ",\n" + _LANE)
def lane_rates(r):
    return stats.lane_rates(lanes(r))


@query("SELECT * FROM medians", LANES + ",\n" + _LANE)
def length_medians(r):
    return stats.upper_median(lanes(r).select("lane", F.length("seq").alias("len")), "lane", "len")


def _points(lane: str, prefix: str = "") -> str:
    c, g = f"n_c / (n_c + n_t + 1)", f"n_g / (n_g + n_a + 1)"
    return f"CASE WHEN (n_c + n_t > 100 AND {c} <= 0.10) OR (n_g + n_a > 100 AND {g} <= 0.10) THEN 80.0::DOUBLE WHEN (n_c + n_t > 100 AND {c} <= 0.15) OR (n_g + n_a > 100 AND {g} <= 0.15) THEN 40.0 ELSE 0.0 END"


def depleted(r: DataFrame) -> DataFrame:
    """Groups of reads by contig, in which C, G or neither is depleted to different degrees."""
    by = (F.col("contig_id") % 4).alias("lane")
    one = F.when((F.col("contig_id") % 4 == 0), F.translate("seq", "C", "T")).when((F.col("contig_id") % 4 == 1) & (F.col("ordinal") % 2 == 0), F.translate("seq", "G", "A")).when((F.col("contig_id") % 4 == 2) & (F.col("ordinal") % 5 != 0), F.translate("seq", "CG", "TA")).otherwise(F.col("seq"))
    return r.select(by, one.alias("seq"))


_DEPLETED = f"""depleted AS (SELECT contig_id % 4 AS lane, CASE WHEN contig_id % 4 = 0 THEN translate(seq, 'C', 'T') WHEN contig_id % 4 = 1 AND ordinal % 2 = 0 THEN translate(seq, 'G', 'A')
  WHEN contig_id % 4 = 2 AND ordinal % 5 <> 0 THEN translate(seq, 'CG', 'TA') ELSE seq END AS seq FROM reads),
dbases AS (SELECT lane, {_COUNT} FROM depleted GROUP BY lane)"""


@query(f"SELECT lane, {_points('')} AS points FROM dbases", _DEPLETED)
def score_bisulfite(r):
    return stats.composition(depleted(r)).select("lane", stats.bisulfite_points(*[F.col(f"n_{b}") for b in "ctga"])["points"].alias("points"))


_RATE = "x AS (SELECT contig_id % 50 AS lane, avg(CASE WHEN ordinal % 50 < contig_id % 50 / 10 THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM reads GROUP BY 1)"


def _rated(r: DataFrame) -> DataFrame:
    return r.groupBy((F.col("contig_id") % 50).alias("lane")).agg(F.avg(F.when(F.col("ordinal") % 50 < F.col("contig_id") % 50 / 10, 1.0).otherwise(0.0)).alias("rate"))


@query("SELECT lane, CASE WHEN rate > 0.05 THEN 90.0::DOUBLE WHEN rate > 0.01 THEN 70.0 WHEN rate > 0.003 THEN 35.0 ELSE 0.0 END AS points FROM x", _RATE)
def score_atac(r):
    return _rated(r).select("lane", stats.atac_points(F.col("rate")).alias("points"))


@query("SELECT lane, CASE WHEN lane % 3 = 0 THEN 0.0::DOUBLE WHEN rate > 0.05 THEN 80.0 WHEN rate > 0.015 THEN 60.0 ELSE 0.0 END AS points FROM x", _RATE)
def score_rna(r):
    return _rated(r).select("lane", stats.rna_points(F.col("rate"), F.when(F.col("lane") % 3 == 0, 80.0).otherwise(0.0)).alias("points"))


_REFERENCE = f"""labelled AS (SELECT DISTINCT contig_id, contig AS seq, CASE contig_id % 5 WHEN 0 THEN 'EXON' WHEN 1 THEN 'PROMOTER' WHEN 2 THEN 'INTRON_CTRL' ELSE 'BACKBONE' END AS label FROM reads
    UNION ALL SELECT DISTINCT contig_id, contig, 'INTRON_CTRL' FROM reads WHERE contig_id % 10 = 0),
rk AS (SELECT label, least(w, {_RC('w')}) AS kmer FROM (SELECT label, substr(seq, unnest(range(1, length(seq) - 15, 5))::INT, 17) AS w FROM labelled)),
ref AS (SELECT kmer, CASE WHEN count(DISTINCT label) FILTER (label <> 'BACKBONE') = 0 THEN 'BACKBONE' WHEN count(DISTINCT label) FILTER (label <> 'BACKBONE') = 1 THEN max(label) FILTER (label <> 'BACKBONE') ELSE 'AMBIGUOUS' END AS label FROM rk GROUP BY kmer)"""


def labelled(r: DataFrame) -> DataFrame:
    m = F.col("contig_id") % 5
    label = F.when(m == 0, "EXON").when(m == 1, "PROMOTER").when(m == 2, "INTRON_CTRL").otherwise("BACKBONE")
    both = F.when(F.col("contig_id") % 10 == 0, F.array(label, F.lit("INTRON_CTRL"))).otherwise(F.array(label))
    return contigs(r).select("contig_id", F.col("contig").alias("seq"), F.explode(both).alias("label"))


@query("SELECT * FROM ref", _REFERENCE)
def kmer_label_merge(r):
    return stats.reference_kmers(labelled(r))


@query(f"SELECT lane, count(*) AS sampled, count(*) FILTER (label = 'EXON') AS exon_hits, count(*) FILTER (label = 'PROMOTER') AS promoter_hits, count(*) FILTER (label = 'INTRON_CTRL') AS intron_hits FROM (SELECT ordinal % 3 AS lane, least(w, {_RC('w')}) AS kmer FROM k) LEFT JOIN ref USING (kmer) GROUP BY lane", _KMERS + ", " + _REFERENCE)
def kmer_label_hits(r):
    return stats.kmer_hits(r.select((F.col("ordinal") % 3).alias("lane"), "seq"), stats.reference_codes(labelled(r)))


@query("SELECT CASE WHEN (SELECT max(barcode_rate) FROM rates) > 0.5 THEN 1 ELSE 0 END + CASE WHEN (SELECT max(umi_rate) FROM rates) > 0.5 THEN 1 ELSE 0 END + CASE WHEN m1 <= 45 AND m2 - m1 >= 30 THEN 1 ELSE 0 END AS signs FROM (SELECT max(median) FILTER (lane = 'R1') AS m1, max(median) FILTER (lane = 'R2') AS m2 FROM medians)", LANES + ",\n" + _LANE)
def sc_layout(r):
    both = lanes(r)
    m = stats.upper_median(both.select("lane", F.length("seq").alias("len")), "lane", "len").agg(F.max(F.when(F.col("lane") == "R1", F.col("median"))).alias("m1"), F.max(F.when(F.col("lane") == "R2", F.col("median"))).alias("m2"))
    top = stats.lane_rates(both).agg(F.max("barcode_rate").alias("cb"), F.max("umi_rate").alias("umi"))
    return m.crossJoin(F.broadcast(top)).select(stats.single_cell(F.col("cb"), F.col("umi"), F.col("m1"), F.col("m2")).alias("signs"))  # one row each


_CALL = f"""pts AS (SELECT (SELECT sum({_points('')}) FROM bases WHERE lane IN ('R1', 'R2')) AS b, (SELECT max(adapter_rate) FROM rates) AS ar, (SELECT max(polyat_rate) FROM rates) AS pr),
call AS (SELECT b AS bisulfite_points, CASE WHEN ar > 0.05 THEN 90.0::DOUBLE WHEN ar > 0.01 THEN 70.0 WHEN ar > 0.003 THEN 35.0 ELSE 0.0 END AS atac_points,
  CASE WHEN b > 30 THEN 0.0::DOUBLE WHEN pr > 0.05 THEN 80.0 WHEN pr > 0.015 THEN 60.0 ELSE 0.0 END AS rna_points FROM pts),
base AS (SELECT *, CASE WHEN greatest(atac_points, rna_points, bisulfite_points) < 20 THEN 'dna' WHEN atac_points >= rna_points AND atac_points >= bisulfite_points THEN 'atac' WHEN rna_points >= bisulfite_points THEN 'rna' ELSE 'bisulfite' END AS a FROM call),
sc AS (SELECT (SELECT max(barcode_rate) FROM rates) > 0.5 OR (SELECT max(umi_rate) FROM rates) > 0.5 OR ((SELECT median FROM medians WHERE lane = 'R1') <= 45 AND (SELECT median FROM medians WHERE lane = 'R2') - (SELECT median FROM medians WHERE lane = 'R1') >= 30) AS s)"""


@query("""SELECT lane, num_reads, polyat_rate, adapter_rate, barcode_rate, umi_rate, n_a, n_c, n_g, n_t, median, bisulfite_points, atac_points, rna_points,
  CASE WHEN s AND a <> 'dna' THEN 'sc-' || a ELSE a END AS assay, CASE WHEN a = 'dna' THEN 'low' WHEN greatest(atac_points, rna_points, bisulfite_points) >= CASE WHEN a = 'rna' THEN 60 ELSE 70 END THEN 'high' ELSE 'medium' END AS confidence
  FROM rates JOIN bases USING (lane) JOIN medians USING (lane), base, sc""", LANES + ",\n" + _LANE + ",\n" + _CALL)
def assay_call(r):
    return stats.assay_call(lanes(r))


_DETAIL = f"""lk AS (SELECT least(w, {_RC('w')}) AS kmer FROM (SELECT substr(upper(seq), i::INT, 17) AS w FROM (SELECT seq, unnest(range(1, length(seq) - 15, 10)) AS i FROM lanes)) WHERE NOT regexp_matches(w, '[^ACGT]')),
lh AS (SELECT count(*) FILTER (label = 'EXON') AS exon, count(*) FILTER (label = 'PROMOTER') AS promoter, count(*) FILTER (label = 'INTRON_CTRL') AS intron FROM lk JOIN ref USING (kmer)),
d1 AS (SELECT bisulfite_points AS b, atac_points + CASE WHEN promoter / (intron + 1) > 5 THEN 50 WHEN promoter / (intron + 1) > 2 THEN 25 ELSE 0 END AS ap, rna_points + CASE WHEN exon / (intron + 1) > 10 THEN 60 WHEN exon / (intron + 1) > 5 THEN 30 ELSE 0 END AS rp,
  ar, pr, promoter / (intron + 1) > 5 AS pa, exon / (intron + 1) > 10 AS ea FROM call, pts, lh),
d2 AS (SELECT *, CASE WHEN greatest(b, ap, rp) < 20 THEN 'dna' WHEN ap >= rp AND ap >= b THEN 'atac' WHEN rp >= b THEN 'rna' ELSE 'bisulfite' END AS a FROM d1),
signs AS (SELECT concat_ws(', ', CASE WHEN (SELECT max(barcode_rate) FROM rates) > 0.5 THEN 'CB tags' END, CASE WHEN (SELECT max(umi_rate) FROM rates) > 0.5 THEN 'UMI tags' END,
  CASE WHEN (SELECT median FROM medians WHERE lane = 'R1') <= 45 AND (SELECT median FROM medians WHERE lane = 'R2') - (SELECT median FROM medians WHERE lane = 'R1') >= 30 THEN 'read length asymmetry' END) AS t)"""


# the reads are no bisulfite reads on any scale of the table: mates have no depleted base, which the SQL takes for granted
@query("""SELECT CASE WHEN t <> '' AND a <> 'dna' THEN 'sc-' || a ELSE a END AS assay, 'N' AS depleted_1, 'N' AS depleted_2, false AS ternary, 'C' AS escape,
  (CASE WHEN a = 'dna' THEN 'low' WHEN greatest(b, ap, rp) >= CASE WHEN a = 'rna' THEN 60 ELSE 70 END THEN 'high' ELSE 'medium' END) || ' (' ||
  (CASE a WHEN 'dna' THEN 'default' WHEN 'atac' THEN concat_ws(', ', CASE WHEN ar > 0.05 THEN 'Tn5 adapters (>5%)' WHEN ar > 0.01 THEN 'Tn5 adapters' WHEN ar > 0.003 THEN 'Tn5 adapters (weak)' END, CASE WHEN pa THEN 'promoter alignment' END)
    WHEN 'rna' THEN concat_ws(', ', CASE WHEN pr > 0.05 THEN 'poly-A/T tails (>5%)' WHEN pr > 0.015 THEN 'poly-A/T tails' END, CASE WHEN ea THEN 'exon alignment' END) ELSE '' END) || (CASE WHEN t <> '' AND a <> 'dna' THEN '; sc: ' || t ELSE '' END) || ')' AS confidence
  FROM d2, signs""", LANES + ",\n" + _LANE + ",\n" + _CALL + ",\n" + _REFERENCE + ",\n" + _DETAIL)
def assay_detail(r):
    """The call with labelled k-mers as further evidence, in words."""
    return stats.assay_detail(lanes(r), stats.reference_codes(labelled(r)))


# -- integrity and the archive ---------------------------------------------------------------------------------

_MEMBERS = "members AS (SELECT 'block_' || (ordinal // 500) || '.txt' AS path, sha256(string_agg(seq || chr(10), '' ORDER BY ordinal)) AS sha256 FROM reads GROUP BY 1)"


def members(r: DataFrame) -> DataFrame:
    path = F.concat(F.lit("block_"), F.col("block").cast("string"), F.lit(".txt"))
    return integrity.block_sha256(r, 500).select(path.alias("path"), "sha256")


@query("SELECT * FROM members", _MEMBERS)
def member_sha256(r):
    return members(r)


@query("SELECT sha256(string_agg(path || chr(10) || sha256 || chr(10), '' ORDER BY path)) AS root FROM members", _MEMBERS)
def integrity_root(r):
    return integrity.root(members(r))


@query("SELECT path, CASE WHEN ends_with(path, '3.txt') THEN 'missing' WHEN ends_with(path, '4.txt') THEN 'undeclared' WHEN ends_with(path, '5.txt') THEN 'mismatch' WHEN ends_with(path, '6.txt') THEN 'duplicate' ELSE 'ok' END AS status FROM members", _MEMBERS)
def container_verify(r):
    m = materialize(members(r), "members")
    ends = lambda d: F.endswith("path", F.lit(f"{d}.txt"))
    declared = m.where(~ends(4)).unionByName(m.where(ends(6)))
    actual = m.where(~ends(3)).withColumn("sha256", F.when(ends(5), F.reverse("sha256")).otherwise(F.col("sha256")))
    return integrity.verify(declared, actual)


@query()
def record_crc(r):
    found = integrity.record_crcs(r)
    return r.sparkSession.createDataFrame([(c, *v) for c, v in found.items()], "channel string, crc32 long, n_records long")


_STREAMS = "files AS (SELECT CASE ordinal % 3 WHEN 0 THEN 'id_' WHEN 1 THEN 'quality_' ELSE 'read_' END || ordinal AS path, length(seq)::BIGINT AS bytes FROM reads)"


@query("SELECT CASE WHEN starts_with(path, 'quality') THEN 'quality' WHEN starts_with(path, 'id') THEN 'id' ELSE 'read' END AS stream, sum(bytes)::BIGINT AS bytes FROM files GROUP BY 1", _STREAMS)
def size_by_stream(r):
    path = F.concat(F.when(F.col("ordinal") % 3 == 0, "id_").when(F.col("ordinal") % 3 == 1, "quality_").otherwise("read_"), F.col("ordinal").cast("string"))
    return r.select(path.alias("path"), F.length("seq").alias("bytes")).groupBy(integrity.stream_class(F.col("path")).alias("stream")).agg(F.sum("bytes").cast("long").alias("bytes"))


@query("SELECT count(*) AS num_reads, count(*) FILTER (contains(seq, 'N')) AS num_with_n, sum(length(id) + 2 * length(seq) + 5)::BIGINT AS original_bytes FROM reads")
def preview_metrics(r):
    return r.agg(F.count("*").alias("num_reads"), F.count(F.when(seq.has_n(F.col("seq")), 1)).alias("num_with_n"), F.sum(F.octet_length(fastx.fastq(F.col("id"), F.col("seq"), F.col("qual"))) + 1).cast("long").alias("original_bytes"))


@query("""SELECT ordinal, CASE WHEN b THEN 'BGZF (Default)' WHEN xfl = 2 THEN 'MAX (Slowest)' WHEN xfl = 4 THEN 'FAST (Fastest)' ELSE 'DEFAULT/OTHER' END AS profile,
  CASE WHEN b THEN 'htslib/samtools/clib' WHEN mtime = 0 AND os = 255 THEN 'Modern pipeline/programmatic' WHEN flg & 8 = 0 THEN 'Programmatic (No filename)' ELSE 'Unknown' END AS origin
  FROM (SELECT ordinal, ordinal % 7 = 0 AS b, ordinal % 5 AS xfl, ordinal % 2 AS mtime, CASE WHEN ordinal % 3 = 0 THEN 255 ELSE 3 END AS os, (ordinal % 16)::INT AS flg FROM reads)""")
def gzip_profile(r):
    b, os, flg = F.col("ordinal") % 7 == 0, F.when(F.col("ordinal") % 3 == 0, 255).otherwise(3), (F.col("ordinal") % 16).cast("int")
    return r.select("ordinal", integrity.gzip_profile(b, F.col("ordinal") % 5).alias("profile"), integrity.gzip_origin(b, F.col("ordinal") % 2, os, flg).alias("origin"))


@query("SELECT lane, ordinal, id, seq, qual FROM lanes", LANES)
def archive_roundtrip(r):
    spark, path = r.sparkSession, scratch_path(r.sparkSession, "archive")
    archive.write(lanes(r).withColumn("qual", F.rpad("qual", F.length("seq"), F.lit("I"))).withColumn("qual", F.substring("qual", F.lit(1), F.when(F.col("lane") == "R1", 60).otherwise(50))), path)
    return archive.read(spark, path)


@query("SELECT lane, ordinal, id, upper(seq) AS seq, qual FROM lanes", LANES)
def archive_transforms(r):
    """Single-cell RNA whose reads give up barcodes, and names that follow from the mate's, and get them back."""
    spark, path = r.sparkSession, scratch_path(r.sparkSession, "archive")
    archive.write(lanes(r).withColumn("seq", F.upper("seq")), path, assay="sc-rna", cb_len=16, mate_names=True)
    return archive.read(spark, path)


@query("SELECT lane, id, upper(seq) AS seq, qual, (row_number() OVER (PARTITION BY lane ORDER BY s1, ordinal) - 1)::BIGINT AS ordinal FROM (SELECT l.*, upper(f.seq) AS s1 FROM lanes l JOIN lanes f ON l.ordinal = f.ordinal AND f.lane = 'R1')", LANES)
def archive_unordered(r):
    """RNA reads that give up their order, and with it their tails: mates stay together."""
    spark, path = r.sparkSession, scratch_path(r.sparkSession, "archive")
    archive.write(lanes(r).withColumn("seq", F.upper("seq")), path, drop="o", assay="rna")
    return archive.read(spark, path)


# -- contigs and overlaps --------------------------------------------------------------------------------------

_VOTES = """votes AS (SELECT contig_id, pos + i - 1 AS place, substr(seq, i::INT, 1) AS base, count(*) AS n FROM (SELECT contig_id, pos, seq, unnest(range(1, length(seq) + 1)) AS i FROM reads) WHERE substr(seq, i::INT, 1) <> 'N' GROUP BY ALL),
cons AS (SELECT contig_id, place, base FROM (SELECT *, row_number() OVER (PARTITION BY contig_id, place ORDER BY n DESC, base) AS k FROM votes) WHERE k = 1)"""


@query("SELECT contig_id, place, base FROM cons", _VOTES)
def contig_consensus(r):
    return consensus.consensus(r)


_CONTIGS = _VOTES + """,
spans AS (SELECT contig_id, min(place) AS first, max(place) AS last FROM cons GROUP BY contig_id),
ctg AS (SELECT contig_id, first, string_agg(coalesce(base, 'N'), '' ORDER BY place) AS seq FROM (SELECT contig_id, first, unnest(range(first, last + 1)) AS place FROM spans) LEFT JOIN cons USING (contig_id, place) GROUP BY contig_id, first),
off AS (SELECT contig_id, length(seq)::BIGINT AS length, (sum(length(seq)) OVER (ORDER BY contig_id) - length(seq))::BIGINT AS start FROM ctg)"""


@query("SELECT * FROM off", _CONTIGS)
def contig_offsets(r):
    return consensus.offsets(consensus.contigs(r))


@query("SELECT contig_id, pos, ordinal, (row_number() OVER (ORDER BY contig_id, pos, ordinal) - 1)::BIGINT AS place FROM reads")
def contig_sort(r):
    return order.with_ordinal(consensus.by_place(r.select("contig_id", "pos", "ordinal")), [F.col("contig_id"), F.col("pos"), F.col("ordinal")], "place")


@query("""SELECT contig_id, ordinal, pos // 16 AS by_place, (SELECT count(*) FROM reads b WHERE b.contig_id = a.contig_id AND b.pos // 64 < a.pos // 64) // 12 AS by_reads FROM shifted_reads a""".replace("reads b", "shifted_reads b"), "shifted_reads AS (SELECT contig_id, ordinal, pos + 64 * (ordinal % 5) AS pos FROM reads)")
def contig_pieces(r):
    """Where contigs of over 16 places, or 12 reads, would be cut."""
    rows = r.select("contig_id", "ordinal", (F.col("pos") + 64 * (F.col("ordinal") % 5)).alias("pos"))
    return consensus.cut(rows, 16, 12).select("contig_id", "ordinal", "piece.*")


_STEPS = "steps AS (SELECT ordinal, ((ordinal * 1000003) % 200000)::BIGINT AS spot, spot - lag(spot) OVER (PARTITION BY ordinal // 10000 ORDER BY ordinal) AS step FROM reads)"


def _placed(r: DataFrame) -> DataFrame:
    return r.select("ordinal", ((F.col("ordinal") * 1000003) % 200000).alias("spot"))


@query("SELECT ordinal, CASE WHEN step BETWEEN 0 AND 65534 THEN step ELSE 65535 END::INT AS delta, CASE WHEN step BETWEEN 0 AND 65534 THEN NULL ELSE spot END AS absolute FROM steps", _STEPS)
def position_delta(r):
    return order.position_deltas(_placed(r), "spot")


@query("SELECT ordinal, spot FROM steps", _STEPS)
def position_restore(r):
    return order.positions(order.position_deltas(_placed(r), "spot"), "spot")


def mutated(r: DataFrame) -> DataFrame:
    """Reads with some bases changed, beside their part of the contig."""
    ref = F.substring("contig", (F.col("pos") + 1).cast("int"), F.lit(60))
    at = (F.col("ordinal") % 60).cast("int")
    changed = F.when(F.col("ordinal") % 2 == 0, F.concat(F.substring(F.col("seq"), F.lit(1), at), F.translate(F.substring(F.col("seq"), at + 1, F.lit(1)), "ACGTN", "CAAGT"), F.substring(F.col("seq"), at + 2, F.length(F.col("seq"))))).otherwise(F.col("seq"))
    return r.select("ordinal", ref.alias("ref"), changed.alias("seq"))


_NOISE_ROWS = ", ".join(f"('{a}', '{b}', '{i}')" for a, bs in consensus.NOISE.items() for i, b in enumerate(bs))
_MUTATED = f"""mut AS (SELECT ordinal, substr(contig, pos + 1, 60) AS ref, CASE WHEN ordinal % 2 = 0 THEN substr(seq, 1, (ordinal % 60)::INT) || translate(substr(seq, (ordinal % 60)::INT + 1, 1), 'ACGTN', 'CAAGT') || substr(seq, (ordinal % 60)::INT + 2) ELSE seq END AS seq FROM reads),
codes(a, b, code) AS (VALUES {_NOISE_ROWS})"""


@query("SELECT ordinal, (i - 1)::INT AS off, code FROM (SELECT ordinal, i, substr(ref, i::INT, 1) AS a, substr(seq, i::INT, 1) AS b FROM (SELECT *, unnest(range(1, 61)) AS i FROM mut)) JOIN codes USING (a, b)", _MUTATED)
def noise_encode(r):
    return mutated(r).select("ordinal", F.explode(consensus.noise(F.col("ref"), F.col("seq"))).alias("x")).select("ordinal", F.col("x.off").alias("off"), F.col("x.code").alias("code"))


@query("SELECT ordinal, seq FROM mut", _MUTATED)
def noise_apply(r):
    return mutated(r).select("ordinal", consensus.apply_noise(F.col("ref"), consensus.noise(F.col("ref"), F.col("seq"))).alias("seq"))


@query("SELECT ordinal, substr(ctg.seq, (pos - first + 1)::INT, 60) AS bases FROM reads JOIN ctg USING (contig_id)", _CONTIGS)
def contig_fetch(r):
    c = materialize(consensus.contigs(r), "contigs")
    placed = c.join(consensus.offsets(c), "contig_id")
    spans = r.join(placed.select("contig_id", "first", "start"), "contig_id").select("ordinal", (F.col("start") + F.col("pos") - F.col("first")).alias("start"), F.lit(60).alias("len"))
    return consensus.fetch(spans, placed.select("start", "seq"))


WINDOWS = overlap.head_windows(60)
_KEYED = " UNION ALL ".join(f"SELECT ordinal, seq, {d} AS dict, substr(seq, {a + 1}, {b - a + 1}) AS key FROM reads WHERE length(seq) > {b}" for d, (a, b) in enumerate(WINDOWS))
_KEYED = f"keyed AS ({_KEYED})"


@query("SELECT dict, key, count(*) AS n, min(ordinal) AS first FROM keyed GROUP BY dict, key", _KEYED)
def dict_buckets(r):
    return overlap.buckets(overlap.keyed(r, WINDOWS))


@query("SELECT ordinal, dict, key, lag(ordinal) OVER (PARTITION BY dict, key ORDER BY ordinal) AS before FROM keyed", _KEYED)
def low_diversity_chains(r):
    return overlap.chains(overlap.keyed(r, WINDOWS))


MIDDLE, SHIFTS = overlap.middle_windows(60), overlap.shifts(60)
_ROWS = lambda windows: ", ".join(f"({d}, {a}, {b})" for d, (a, b) in enumerate(windows))
_SHIFTED = f"shifted AS (SELECT ordinal, dict, shift::INT AS shift, substr(seq, (a + shift + 1)::INT, b - a + 1) AS key FROM reads, (VALUES {_ROWS(MIDDLE)}) w(dict, a, b), range({len(SHIFTS)}) t(shift) WHERE length(seq) > b + shift)"


@query("SELECT shift, dict, count(*) AS n, count(DISTINCT key) AS keys FROM shifted GROUP BY shift, dict", _SHIFTED)
def shift_candidates(r):
    """How many reads, and keys, each shift of the overlap search has in each of its windows."""
    longest = r.agg(F.max(F.length("seq"))).first()[0] or 0
    return overlap.shift_counts(r, overlap.middle_windows(longest), overlap.shifts(longest))


_BITS = "list_sum(list_transform(range(1, 61), lambda i: CASE WHEN substr(x, i::INT, 1) = substr(y, i::INT, 1) THEN 0 WHEN translate(substr(x, i::INT, 1), 'ACGT', 'TGCA') = substr(y, i::INT, 1) AND substr(x, i::INT, 1) <> 'N' THEN 2 ELSE 1 END))::INT"


@query(f"SELECT a.ordinal AS a, b.ordinal AS b, {_BITS.replace('(x,', '(a.seq,').replace('(y,', '(b.seq,')} AS distance FROM keyed a JOIN keyed b ON a.dict = 0 AND b.dict = 0 AND a.key = b.key AND a.ordinal < b.ordinal", _KEYED)
def hamming_pairs(r):
    k = overlap.keyed(r, WINDOWS[:1])
    a, b = k.select(F.col("ordinal").alias("a"), F.col("seq").alias("x"), "key"), k.select(F.col("ordinal").alias("b"), F.col("seq").alias("y"), "key")
    return a.join(b, "key").where("a < b").select("a", "b", overlap.bit_distance(F.col("x"), F.col("y")).alias("distance"))


_BITS3 = "coalesce(list_sum(list_transform(range(1, length(y) + 1), lambda i: bit_count(xor(translate(substr(x, spot + i::INT, 1), 'AGCTN', '02461')::INT, translate(substr(y, i::INT, 1), 'AGCTN', '02461')::INT)))), 0)::INT"
_ABSORBED = f"""ways AS (SELECT contig_id, 'd' AS orientation, seq AS x FROM (SELECT DISTINCT contig_id, contig AS seq FROM reads) UNION ALL SELECT contig_id, 'r', {_RC('contig')} FROM (SELECT DISTINCT contig_id, contig FROM reads)),
looks AS (SELECT contig_id, orientation, x, dict, spot::INT AS spot, substr(x, (spot + a + 1)::INT, b - a + 1) AS key FROM (SELECT *, unnest(range(0, length(x) - b)) AS spot FROM ways, (VALUES {_ROWS(WINDOWS)}) w(dict, a, b))),
met AS (SELECT contig_id, ordinal, orientation, x, k.seq AS y, spot FROM looks JOIN keyed k USING (dict, key) WHERE spot + length(k.seq) <= length(x)),
measured AS (SELECT contig_id, ordinal, orientation, CASE WHEN orientation = 'r' THEN length(x) - spot - length(y) ELSE spot END::INT AS place, {_BITS3} AS distance FROM met)"""


@query("SELECT contig_id, ordinal, place, orientation, distance FROM (SELECT *, row_number() OVER (PARTITION BY contig_id, ordinal ORDER BY distance, place, orientation) AS k FROM measured WHERE distance <= 24) WHERE k = 1", _KEYED + ",\n" + _ABSORBED)
def absorb_candidates(r):
    return overlap.absorbed(contigs(r).select("contig_id", F.col("contig").alias("seq")), r, WINDOWS)


@query("SELECT ordinal, id, seq, qual FROM reads")
def overlap_roundtrip(r):
    """Reads as contigs and noise, those with N left as they are; then put together again."""
    clean = r.where(~seq.has_n(F.col("seq")))
    c = materialize(consensus.contigs(clean).withColumnRenamed("seq", "contig_seq"), "contigs")
    placed = clean.select("ordinal", "contig_id", "pos", "seq").join(c, "contig_id")
    ref = F.substring("contig_seq", (F.col("pos") - F.col("first") + 1).cast("int"), F.length("seq"))
    aligned = materialize(placed.select("ordinal", "contig_id", "pos", F.length("seq").alias("len"), consensus.noise(ref, F.col("seq")).alias("noise")), "alignments")
    back = aligned.join(c, "contig_id").withColumn("ref", F.substring("contig_seq", (F.col("pos") - F.col("first") + 1).cast("int"), F.col("len")))
    back = back.select("ordinal", consensus.apply_noise(F.col("ref"), F.col("noise")).alias("back"))
    # reads that no contig has keep their own bases
    both = packing.looked_up(r.select("ordinal", "id", "seq", "qual"), back, "ordinal").withColumn("seq", F.coalesce("back", "seq")).drop("back")
    return packing.ranged(both, "ordinal", r.count()).sortWithinPartitions("ordinal")


@query()
def greedy_clusters(r):
    """Each read with the one that it hangs on: the nearest of those before it whose overlap it shares, on either side and strand, by any of the windows."""
    n, longest = r.agg(F.count("*"), F.max(F.length("seq"))).first()
    longest = longest or 0
    return overlap.nearest_before(r.select("ordinal", "seq"), overlap.windows_for(n, overlap.middle_windows(longest), overlap.ONE_WINDOW_BELOW), overlap.shifts(longest))
