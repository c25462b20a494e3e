"""Queries of the functions on legal texts: phrases stand around every document's whole text, and the SQL gives what must come of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import dates, legal, strings
from statuta.operators import outlines, references
from statuta.plans import templates as T
from statuta.plans.registry import query
from statuta.runtime import table

KEY = T.KEY


def _cases(spark: SparkSession, sf_dir: str, *texts: list[str | None], names: tuple[str, ...] = ("text",)) -> DataFrame:
    return T.rows(spark, sf_dir, **dict(zip(names, texts, strict=True)))


_want = T.want


NUMBERS = [("XIV", "14", "xiv", "14"), (" 12A ", "12a", "12a", "12a"), ("thứ nhất", "thu_nhat", "thu_nhat", "1"), ("Mười", "muoi", "muoi", "10"), ("iv", "4", "iv", "4"), ("{n}", "{n}", "{n}", "{n}"), ("Mục {n}b {h}", "muc_{n}b_{h}", "muc_{n}b_{h}", "muc_{n}b_{h}")]


@query(_want(chapter=[r[1] for r in NUMBERS], section=[r[2] for r in NUMBERS], part=[r[3] for r in NUMBERS]))
def str3_structural_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _cases(spark, sf_dir, [r[0] for r in NUMBERS]).select(KEY, legal.chapter_number(t).alias("chapter"), legal.section_number(t).alias("section"), legal.part_number(t).alias("part"))


LABELS = [("12 A", "12a", None, "12_a"), ("{n}b", "{n}b", None, "{n}b"), ("Đ", None, "đ", "dd"), (" c ", None, "c", "c"), (" {h}", None, None, "{h}"), ("7", "7", None, "7")]


@query(_want(number=[r[1] for r in LABELS], point=[r[2] for r in LABELS], point_id=[r[3] for r in LABELS]))
def str5_numbers_and_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR5, STR6: checked legal numbers and point labels, and the ids of points."""
    t = F.col("text")
    return _cases(spark, sf_dir, [r[0] for r in LABELS]).select(KEY, legal.legal_number(t).alias("number"), legal.point(t).alias("point"), legal.point_id(t).alias("point_id"))


#: Numbers and citations with marks set apart from their letters, and what they are composed.
LOOSE = [(" {n} /2020/ nđ-cp\u00a0", "{n}/2020/NĐ-CP", "{n} /2020/ nđ-cp"), ("Đie\u0302\u0300u  {n}\t{t}", None, "Điều {n} {t}"), ("qh{n}\u200914a", "QH{n}14A", "qh{n} 14a"), (" \n", None, ""), (None, None, None)]


@query(_want(number=[r[1] for r in LOOSE], citation=[r[2] for r in LOOSE]))
def str4_composed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4, STR7: document numbers and citations with Unicode composed; a blank number is none (or an error, if asked for)."""
    t = F.col("text")
    rows = _cases(spark, sf_dir, [r[0] for r in LOOSE])
    return rows.select(KEY, F.when(F.col(KEY) % len(LOOSE) != 1, legal.document_number(t)).alias("number"), legal.citation_text(t).alias("citation"))


SCANNED = [("t heo quy định {h}", "theo quy định {h}"), ("qu ản lý nhà nước {h}", "quản lý nhà nước {h}"), ("{h}. 4 CÔNG BÁO/Số 1175 + 1176/Ngày 30-12-2014", "{h}."), ("nhi ệm vụ {h}", "nhiệm vụ {h}"), ("  plain   text {h}", "plain text {h}"), ("t rên d oanh ngh iệp {h}", "trên doanh nghiệp {h}")]


@query(_want(repaired=[r[1] for r in SCANNED]))
def str10_spacing_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir, [r[0] for r in SCANNED]).select(KEY, legal.spacing_repaired("text").alias("repaired"))


LINES = [
    ("Phần thứ nhất", "Part", "thứ nhất", None, "false"), ("Phần II: Chung {t}", "Part", "ii", "Chung {t}", "false"), ("Chương iv QUY ĐỊNH {t}", "Chapter", "IV", "QUY ĐỊNH {t}", "false"), ("Mục {n}.", "Section", "{n}", None, "false"), ("Tiểu mục 2. Khác {t}", "Subsection", "2", "Khác {t}", "false"),
    ("Điều {n}a[1]. Phạm vi {t}", "Article", "{n}a", "Phạm vi {t}", "false"), ("{n}. Nội dung {t}", "Clause", "{n}", "Nội dung {t}", "false"), ("đ) điểm {t}", "Point", "đ", "điểm {t}", "false"), ("theo Điều {n} của Luật {t}", None, None, None, "false"), ("Mục 1 Chương III", None, None, None, "false"), ("QUY ĐỊNH CHUNG; 5%", None, None, None, "true"), ("12-34", None, None, None, "false"),
]


@query(_want(kind=[r[1] for r in LINES], number=[r[2] for r in LINES], title=[r[3] for r in LINES], uppercase=[r[4] for r in LINES]))
def str12_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR11, STR12: all kinds of heading lines, and lines in capitals."""
    h = _cases(spark, sf_dir, [r[0] for r in LINES]).select(KEY, legal.heading(F.col("text")).alias("h"), strings.is_uppercase_title(F.col("text")).cast("string").alias("uppercase"))
    return h.select(KEY, "h.kind", "h.number", "h.title", "uppercase")


APPENDICES = [
    ("Phụ lục", "true", None, None, "UNCLASSIFIED"), ("PHỤ LỤC SỐ {n}: BIỂU MẪU", "true", "{n}", "BIỂU MẪU", "FORM"), ("Phụ lục II. Danh mục hàng {t}", "true", "II", "Danh mục hàng {t}", "LIST"), ("Phụ lục kèm theo", "false", None, None, "UNCLASSIFIED"),
    ("PHỤ LỤC BẢNG GIÁ {n}", "true", None, "BẢNG GIÁ {n}", "TABLE"), ("Phụ lục 3 của Nghị định này {t}", "false", None, None, "UNCLASSIFIED"), ("Phụ lục A-1 QUY ĐỊNH {n}", "true", "A-1", "QUY ĐỊNH {n}", "UNCLASSIFIED"), ("Điều {n}. Khác {t}", "false", None, None, "LEGAL_CONTENT"),
]


@query(_want(appendix=[r[1] for r in APPENDICES], number=[r[2] for r in APPENDICES], title=[r[3] for r in APPENDICES], kind=[r[4] for r in APPENDICES]))
def str13_appendix_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR13, STR14: appendix heading lines, and kinds by heading and body."""
    t = F.col("text")
    has_article = F.coalesce(legal.heading(t)["kind"] == "Article", F.lit(False))
    found = _cases(spark, sf_dir, [r[0] for r in APPENDICES]).select(KEY, legal.appendix_heading(t).alias("h"), legal.appendix_kind(t, has_article).alias("kind"))
    return found.select(KEY, F.col("h").isNotNull().cast("string").alias("appendix"), "h.number", "h.title", "kind")


@query(r"""SELECT doc_id, trim(regexp_replace(flat, '([+\-!(){}\[\]^"~*?:\\/]|&&|\|\|)', '\\\1', 'g')) AS lucene, regexp_replace(flat, '([\\`*_<>{}\[\]#])', '\\\1', 'g') || ' [' || doc_id || '][1]' AS markdown FROM """ + T.FROM_SQL)
def str15_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR15, STR16: escapes of query syntax, and an answer's statements as Markdown with their citations, of whole texts."""
    statement = F.struct(F.col("flat"), F.array(F.col(KEY), F.lit(1).cast("long")).alias("citations"))
    return T.flats(spark, sf_dir).select(KEY, legal.escape_lucene(F.col("flat")).alias("lucene"), legal.rendered(F.array(F.array(statement.withField("text", F.col("flat"))))).alias("markdown"))


@query(f"""SELECT {KEY}, CASE {KEY} % 4 WHEN 0 THEN 'Điều ' || {KEY} || ' Khoản 2 Điểm a 59/2020' WHEN 1 THEN 'Điều ' || {KEY} || ' ' || flat WHEN 2 THEN 'd' || {KEY} ELSE 'Khoản 2 59/2020' END AS label,
CASE {KEY} % 4 WHEN 0 THEN 'Phụ lục' || chr(10) || flat WHEN 1 THEN flat || chr(10) || 'x' WHEN 2 THEN '' ELSE 'Phụ lục' || chr(10) || 'x' END AS appendix FROM """ + T.FROM_SQL)
def str18_labels_and_appendix_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR18, STR20: canonical labels, and what is embedded of appendices."""
    k, none = F.col(KEY) % 4, F.lit(None).cast("string")
    label = legal.canonical_label(F.when(k < 2, F.col(KEY).cast("string")), F.when(k.isin(0, 3), "2"), F.when(k == 0, "a"), F.when(k.isin(0, 3), "59/2020").otherwise(" "), F.when(k == 1, F.col("flat")), F.concat(F.lit("d"), F.col(KEY).cast("string")))
    text = legal.appendix_text(F.when(k.isin(0, 3), "Phụ lục").otherwise(none), F.when(k < 2, F.col("flat")).otherwise(" "), F.when(k.isin(1, 3), "x"))
    return T.flats(spark, sf_dir).select(KEY, label.alias("label"), text.alias("appendix"))


DOCUMENTS = [
    ("Hiến pháp", "{n}/2013/QH13", "Constitution", "Constitution", "HP{n}_2013"), ("Bộ luật Dân sự", "91/2015/QH13", "Law", "Law", "BL91_2015"), ("Về giá {n}", "{n}/2021/NĐ-CP", "Circular", "Decree", "ND{n}_2021"), ("Thông tư liên tịch {n}", "01/TTLT-BTC", "JointCircular", "JointCircular", "TTLT01_unknown"),
    ("Quyết định về luật", "5", "Law", "Decision", "L5_unknown"), ("Quy chế {n}", " ", "Circular", None, "QC_quy_che_{n}_t"), ("Other {n}", "9", "Circular", None, "DOC9_unknown"),
]


@query(_want(by_title=[r[2] for r in DOCUMENTS], kind=[r[3] for r in DOCUMENTS], code=[r[4] for r in DOCUMENTS]))
def str21_document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR21, STR22, STR26: types by title, by title or number, and codes."""
    rows = _cases(spark, sf_dir, [r[0] for r in DOCUMENTS], [r[1] for r in DOCUMENTS], names=("title", "number"))
    return rows.select(KEY, legal.type_of_title(F.col("title")).alias("by_title"), legal.type_of_document(F.col("title"), F.col("number")).alias("kind"), legal.raw_code(F.col("number"), F.col("title"), F.lit("t")).alias("code"))


STATES = [("Còn hiệu lực", "Quốc hội", "ACTIVE", "LEGISLATIVE"), ("Hết hiệu lực một phần ", "Bộ Tài chính", "PARTIALLY_EFFECTIVE", "EXECUTIVE"), ("Bị bãi bỏ", "Tòa án nhân dân tối cao", "REPEALED", "JUDICIAL"), (None, "Hội {n}", "ACTIVE", "OTHER"), ("unsure {t}", "Thủ tướng", None, "EXECUTIVE")]


@query(_want(status=[r[2] for r in STATES], branch=[r[3] for r in STATES]))
def str23_status_and_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR23, STR24: branches of issuers, and statuses by wording, null for unknown wordings."""
    return _cases(spark, sf_dir, [r[0] for r in STATES], [r[1] for r in STATES], names=("status", "issuer")).select(KEY, legal.legal_status(F.col("status")).alias("status"), legal.issuer_branch(F.col("issuer")).alias("branch"))


PREFIXES = [("REFERENCE", "{t}", "REFERS_TO"), ("CHANGE_CONTENT", "{t} 1. Sửa đổi, bổ sung ", "AMENDS"), ("CHANGE_CONTENT", "{t} Bổ sung khoản {n} vào sau ", "POSITIONAL_ANCHOR"), ("CHANGE_CONTENT", "{t} bãi bỏ các", "REPEALS"), ("CHANGE_CONTENT", "Thay cụm từ {t} tại", "AMENDS"), ("CHANGE_CONTENT", "theo {t}", "UNKNOWN"), ("OTHER", "sửa đổi", "UNKNOWN")]


@query(_want(relation=[r[2] for r in PREFIXES]))
def str32_relation_of_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir, [r[0] for r in PREFIXES], [r[1] for r in PREFIXES], names=("link", "text")).select(KEY, legal.relation_of_prefix(F.col("link"), F.col("text")).alias("relation"))


@query("""WITH s AS (SELECT * FROM (VALUES (0, 1, 'I/ CHUNG', 'a {t}'), (0, 2, 'II. RIÊNG', 'b' || chr(10) || 'c'), (1, 1, '', 'intro'), (1, 2, 'IV- KHÁC', 'x {t}'), (2, 1, '[Phần 1]', 'only {n}')) v(k, pos, title, content))
SELECT doc_id, pos::BIGINT AS pos, 'SP_' || pos AS number, CASE WHEN title = '' THEN '[Phần 1]' ELSE title END AS title, replace(replace(content, '{n}', doc_id::VARCHAR), '{t}', flat) AS content FROM """ + T.FROM_SQL + " JOIN s ON k = doc_id % 3")
def ing6_synthetic_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR34, ING6: articles of texts without any, by their Roman outline, else by size."""
    texts = ["I/ CHUNG\na {t}\nII. RIÊNG\nb\nc", "intro\nIV- KHÁC\n x {t} ", "only {n}"]
    return outlines.synthetic_articles(_cases(spark, sf_dir, texts), KEY, "text")


@query("""WITH p AS (SELECT doc_id, text FROM documents), n AS (SELECT doc_id, length(text) AS n FROM p) SELECT doc_id, n::BIGINT AS n_chars, true AS bounded, true AS whole FROM n WHERE n > 0""")
def str34_size_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in pieces of at most 3,000 characters that end at line ends where they can; nothing but white space is lost."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text", outlines.size_pieces("text", F.lit(3000)).alias("parts"))
    bare = F.regexp_replace(F.array_join("parts", ""), r"\s", "") == F.regexp_replace("text", r"\s", "")
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.forall("parts", lambda p: F.length(p) <= 3000).alias("bounded"), bare.alias("whole"))


SPOKEN = [("có hiệu lực ngày 05 tháng 3 năm 2021, nay {t}", "day", "2021-03-05", "2021-03-05"), ("ngày 31/02/2020 hiện nay", "current", None, None), ("tháng 2/2020", "month", "2020-02-01", "2020-02-29"), ("trong năm 2014 {h}", "year", "2014-01-01", "2014-12-31"), ("trước và sau khi sửa đổi {h}", "versions", None, None), ("thời hạn bao nhiêu ngày {h}", "none", None, None), ("Luật năm 2014 còn hiệu lực không", "current", None, None), ("2020-05-06 {n}", "day", "2020-05-06", "2020-05-06")]


@query(_want(granularity=[r[1] for r in SPOKEN], first=[r[2] for r in SPOKEN], last=[r[3] for r in SPOKEN]))
def dat1_spoken_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT1, DAT2: days in figures and words, current validity, months, years, spans of versions, in that order."""
    rows = _cases(spark, sf_dir, [r[0] for r in SPOKEN]).select(KEY, dates.spoken_scope(F.col("text")).alias("s"))
    return rows.select(KEY, "s.granularity", F.col("s.start").cast("string").alias("first"), F.col("s.end").cast("string").alias("last"))


SOURCES = [("{t} Luật có hiệu lực thi hành từ ngày 1 tháng 7 năm 2021. {t}", "2021-07-01", "one"), ("có hiệu lực kể từ ngày 1 tháng 7 năm 2021; {t} có  hiệu lực từ ngày 01 tháng 07 năm 2021", "2021-07-01", "one"), ("có hiệu lực từ ngày 1 tháng 7 năm 2021, {t} có hiệu lực từ ngày 2 tháng 7 năm 2021", None, "conflict"), ("{t} có hiệu lực từ ngày 31 tháng 2 năm 2021", None, "invalid"), ("không {t}", None, "none")]


@query(_want(effective=[r[1] for r in SOURCES], status=[r[2] for r in SOURCES]))
def dat3_source_effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, [r[0] for r in SOURCES]).select(KEY, dates.source_effective(F.col("text")).alias("s"))
    return rows.select(KEY, F.col("s.day").cast("string").alias("effective"), "s.status")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN NULL ELSE '2020-02-03' END AS iso_day, CASE event_id % 4 WHEN 2 THEN NULL WHEN 3 THEN '2020-02-03T04:05:06Z' WHEN 1 THEN '2020-02-03 04:05:06' ELSE strftime(ts, '%Y-%m-%d') END AS iso_time,
CASE event_id % 4 WHEN 2 THEN 'none' WHEN 3 THEN 'zoned' ELSE 'naive' END AS zone, contains(strftime(ts, '%Y-%m-%d'), '2024-01') AS in_month FROM events""")
def dat4_iso_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT4, DAT6: checked ISO days and times, whether a time names its zone, and dates by what they contain."""
    k, day = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd")
    e = table(spark, sf_dir, "events")
    first = F.when(k == 0, day).when(k == 1, "2020-02-30").otherwise("2020-02-03")
    time = F.when(k == 2, "soon").when(k == 3, "2020-02-03T04:05:06Z").when(k == 1, "2020-02-03 04:05:06").otherwise(day)
    return e.select("event_id", dates.iso_day(first).alias("iso_day"), dates.iso_time(time).alias("iso_time"), dates.zone_of(time).alias("zone"), dates.contains_year(F.col("ts").cast("date"), "2024-01").alias("in_month"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS presence, CASE WHEN p_size % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS resolvable, p_size < 30 AND 20 < p_size + 5 AS overlap,
length('{"a":"' || p_brand || '","b":null,"c":' || p_size || '}')::BIGINT AS cost FROM part""")
def mth3_scores_and_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH3, MTH4, ARR3, JSN3: evidence in texts, resolvable ids, overlapping spans, and lengths of compact JSON."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    evidence = F.when(k == 0, F.concat(F.lit(" "), name)).when(k == 1, F.concat(F.lit("zzz "), F.substring_index(name, " ", 1), F.lit(" zzz"))).when(k == 2, " ").otherwise("zzz yyy")
    ids = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", F.lit("none"))).otherwise(F.array().cast("array<string>"))
    value = F.struct(F.col("p_brand").alias("a"), F.lit(None).cast("string").alias("b"), F.col("p_size").alias("c"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", legal.evidence_presence(evidence, F.concat(name, F.lit(" tail"))).alias("presence"), legal.resolvable(ids, F.array("p_brand")).alias("resolvable"),
        legal.overlaps(F.col("p_size"), F.col("p_size") + 5, F.lit(20), F.lit(30)).alias("overlap"), legal.serialized_cost(value).cast("long").alias("cost"),
    )


@query("""SELECT vec_id, len(embedding) = 64 AS fits FROM embeddings""")
def arr4_vector_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.size("embedding") == 64).alias("fits"))


LISTS = [("các khoản 1, 2 và {n}", "1,2,{n}"), ("khoản 3a, 3a và 4", "3a,4"), ("không có", ""), (None, None)]
NAMES = [("AMENDED_BY", "AMENDS", None), ("GUIDED_BY", "GUIDES", None), ("Entity", None, "LegalSubject"), ("CONTAINS", None, None), ("Action", None, "LegalAction"), ("REFERENCES", "REFERS_TO", None)]


@query(_want(listed=[LISTS[i % 4][1] for i in range(12)], relation=[NAMES[i % 6][1] for i in range(12)], label=[NAMES[i % 6][2] for i in range(12)]))
def map1_lists_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR2, MAP1: listed numbers, and the present names of old relations and labels."""
    rows = _cases(spark, sf_dir, [LISTS[i % 4][0] for i in range(12)], [NAMES[i % 6][0] for i in range(12)], names=("text", "name"))
    return rows.select(KEY, F.array_join(references.listed(F.col("text")), ",").alias("listed"), legal.looked_up(F.col("name"), legal.RELATION_ALIASES).alias("relation"), legal.looked_up(F.col("name"), legal.LABEL_ALIASES).alias("label"))


CATEGORIES = [
    ("Văn bản được thay thế (3)", "supported", "REPLACES", "CURRENT_TO_TARGET"), ("Văn bản sửa đổi bổ sung", "supported", "AMENDS", "TARGET_TO_CURRENT"), ("Căn cứ ban hành ({n})", "unsupported", None, None), ("Văn bản lạ {t}", "unknown", None, None),
    ("Văn bản bãi bỏ (1) ", "supported", "REPEALS", "TARGET_TO_CURRENT"), ("Văn bản quy định chi tiết, hướng dẫn thi hành", "supported", "GUIDES", "CURRENT_TO_TARGET"), (" ", "empty", None, None),
]


@query(_want(state=[r[1] for r in CATEGORIES], relation=[r[2] for r in CATEGORIES], direction=[r[3] for r in CATEGORIES]))
def flt18_diagram_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT18, MAP2, STR31: categories without their counts, by the eight relations they stand for, known but unused, or unknown."""
    rows = _cases(spark, sf_dir, [r[0] for r in CATEGORIES], names=("category",)).withColumn("targets", F.when(F.trim("category") != "", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return outlines.categorised(rows, "category", "targets").select(KEY, "state", "relation", "direction")


@query("""SELECT doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS canonical FROM documents""")
def src4_canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: composed Unicode and LF line ends, as a digest of each whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(legal.nfc(F.regexp_replace("text", "\r\n?", "\n")).cast("binary"), 256).alias("canonical"))
