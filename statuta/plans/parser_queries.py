"""Queries of the outline parser, over laws that hold every document's whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import outline_parser
from statuta.plans import templates as T
from statuta.plans.registry import query
from statuta.runtime import table

KEY = T.KEY

#: A text, its units (line, kind, number, title, line of the parent, content), and its state.
TEXTS = [
    (
        "QUỐC HỘI\n7\nPhần thứ nhất\nQUY ĐỊNH CHUNG\nChương I NHỮNG ĐIỀU\nMục 1. Phạm vi\nTiểu mục 1\nRIÊNG\nĐiều 1. Phạm vi {n}\n1. Luật này {t}\náp dụng\na) người\nb) tổ chức\na) lặp lại\n2. Khác\n2. nữa\nChương II\nĐiều 2\nÁp dụng luật\nNội dung {t}",
        [(2, "Part", "thứ nhất", "QUY ĐỊNH CHUNG", None, ""), (4, "Chapter", "I", "NHỮNG ĐIỀU", 2, ""), (5, "Section", "1", "Phạm vi", 4, ""), (6, "Subsection", "1", "RIÊNG", 5, ""), (8, "Article", "1", "Phạm vi {n}", 6, ""), (9, "Clause", "1", "Luật này {t}", 8, "Luật này {t} áp dụng"),
         (11, "Point", "a", "người", 9, "người"), (12, "Point", "b", "tổ chức", 9, "tổ chức a) lặp lại"), (14, "Clause", "2", "Khác", 8, "Khác 2. nữa"), (16, "Chapter", "II", None, 2, ""), (17, "Article", "2", "Áp dụng luật", 16, "Nội dung {t}")],
        ("PARSED", 2, None),
    ),
    (
        "Điều 1. Sửa đổi\n1. Sửa đổi Điều 5 như sau:\n“Điều 5. Cũ {n}\n1. Khoản mới\na) điểm”.\n2. Bãi bỏ khoản 3 theo\nĐiều 7\ncủa Luật này {t}",
        [(0, "Article", "1", "Sửa đổi", None, ""), (1, "Clause", "1", "Sửa đổi Điều 5 như sau:", 0, "Sửa đổi Điều 5 như sau: “Điều 5. Cũ {n} 1. Khoản mới a) điểm”."), (5, "Clause", "2", "Bãi bỏ khoản 3 theo", 0, "Bãi bỏ khoản 3 theo Điều 7 của Luật này {t}")],
        ("PARSED", 1, None),
    ),
    ("Thông báo {t}\nkhông có điều nào\na) mục {t}", [], ("SOURCE_PRESERVED", 0, "no_article_boundary")),
    (
        "Mục 3\nĐiều 1. A\n1. Thay thế Điều 2 như sau:\n“Điều 2. Mở\nPhần II",
        [(0, "Section", "3", None, None, ""), (1, "Article", "1", "A", 0, ""), (2, "Clause", "1", "Thay thế Điều 2 như sau:", 1, "Thay thế Điều 2 như sau: “Điều 2. Mở")],
        ("PARSED_WITH_WARNINGS", 1, "unclosed_quote"),
    ),
    ("Chương I\nTiểu mục 1. X\nĐiều {n}. B", [(0, "Chapter", "I", None, None, ""), (1, "Subsection", "1", "X", 0, ""), (2, "Article", "{n}", "B", 1, "")], ("SOURCE_PRESERVED", 1, "subsection_outside_section")),
]


def _sql(v: str | int | None) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline_parser.roles(T.rows(spark, sf_dir, text=[t for t, _, _ in TEXTS]))


UNIT_ROWS = ", ".join(f"({k}, {', '.join(map(_sql, u))})" for k, (_, us, _) in enumerate(TEXTS) for u in us)


@query(f"""WITH v(k, line_no, kind, number, title, parent_line, content) AS (VALUES {UNIT_ROWS}) SELECT doc_id, line_no::BIGINT AS line_no, kind, replace(number, '{{n}}', {KEY}::VARCHAR) AS number, replace(replace(title, '{{n}}', {KEY}::VARCHAR), '{{t}}', flat) AS title,
parent_line::BIGINT AS parent_line, replace(replace(content, '{{n}}', {KEY}::VARCHAR), '{{t}}', flat) AS content FROM """ + T.FROM_SQL + f" JOIN v ON k = {KEY} % {len(TEXTS)}")
def ing1_outline_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ING1, ING2, WIN9 to WIN11, WIN13, STR12: units of all kinds with parents and contents; quoted wording and repeated numbers are text."""
    u = outline_parser.units(_found(spark, sf_dir))
    return u.select("doc_id", "line_no", "kind", "number", "title", "parent_line", "content")


@query(f"SELECT doc_id, {T.sql([s[0] for _, _, s in TEXTS])} AS status, {T.sql([str(s[1]) for _, _, s in TEXTS])}::BIGINT AS n_articles, {T.sql([s[2] for _, _, s in TEXTS])} AS reason FROM {T.FROM_SQL}")
def ing4_parse_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline_parser.diagnostics(_found(spark, sf_dir))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), chr(10)), chr(10))) AS line FROM documents), f AS (SELECT doc_id, count(*) AS n FROM l WHERE trim(line) <> '' AND NOT regexp_full_match(trim(line), '[0-9]+') GROUP BY doc_id) SELECT doc_id, n AS n_lines FROM f""")
def ing1_counted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that count of whole documents: blank ones and page numbers go."""
    return outline_parser.roles(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


#: Texts that one pass reads and the other doesn't, the numbers of their bold lines, and their units (line, kind, number, title, line of the parent, content) with the pass.
PASSES = [
    ("Điều 1. A {h}\n1. {t}", [], [(0, "Article", "1", "A {h}", None, ""), (1, "Clause", "1", "{t}", 0, "{t}")], "strict"),
    ("- Điều 1. Phạm vi {h}\n1. {t}\n“Điều 2[3]: Đối tượng\nnội dung {t}", [], [(0, "Article", "1", "Phạm vi {h}", None, ""), (1, "Clause", "1", "{t}", 0, "{t}"), (2, "Article", "2", "Đối tượng", None, "nội dung {t}")], "loose"),
    ("Chương I\nNhững quy định chung {h}\nĐiều 1. A\nđiều 2 trong câu\n{t}", [1], [(0, "Chapter", "I", "Những quy định chung {h}", None, ""), (2, "Article", "1", "A", 0, "điều 2 trong câu {t}")], "strict"),
    ("Chương I\nNhững quy định chung {h}\nĐiều 1. A", [], [(0, "Chapter", "I", None, None, "Những quy định chung {h}"), (2, "Article", "1", "A", 0, "")], "strict"),
    ("Thông báo {t}\nđiều 5 trong câu", [], [], "strict"),
]
PASS_ROWS = ", ".join(f"({k}, {', '.join(map(_sql, u))}, '{p}')" for k, (_, _, us, p) in enumerate(PASSES) for u in us)


def _filled(column: str) -> str:
    return f"replace(replace(replace({column}, '{{n}}', doc_id::VARCHAR), '{{h}}', md5(flat)), '{{t}}', flat) AS {column}"


@query(f"WITH v(k, line_no, kind, number, title, parent_line, content, pass) AS (VALUES {PASS_ROWS}) SELECT doc_id, line_no::BIGINT AS line_no, kind, number, {_filled('title')}, parent_line::BIGINT AS parent_line, {_filled('content')}, pass FROM {T.FROM_SQL} JOIN v ON k = doc_id % {len(PASSES)}")
def ing1_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ING1 whole: a strict pass over all documents and a loose one over those in which it found no article; bold lines as titles."""
    bold = F.get(F.array(*[F.array(*map(F.lit, b)).cast("array<long>") if b else F.array().cast("array<long>") for _, b, _, _ in PASSES]), (F.col(KEY) % len(PASSES)).cast("int"))
    docs = T.rows(spark, sf_dir, text=[t for t, *_ in PASSES]).withColumn("bold", bold)
    found = outline_parser.parsed(docs, bold_col="bold")
    u = outline_parser.units(found)
    return u.join(found.select("doc_id", "line_no", "pass"), ["doc_id", "line_no"]).select("doc_id", "line_no", "kind", "number", "title", "parent_line", "content", "pass")


#: Texts with attached parts, and the parts of their lines in order: owner, scope, kind.
PARTS = [
    ("Điều 1. A\n{t}\nQUY CHẾ LÀM VIỆC\n\n(Ban hành kèm theo Quyết định số 1)\nĐiều 1. B\nPHỤ LỤC I\n{t}\nĐIỀU LỆ\nkèm theo Luật này {t}\nc", ["main,0,"] * 2 + ["instrument,1,REGULATION"] * 6 + ["instrument,2,CHARTER"] * 3),
    ("Điều 1. A {t}\nPhụ lục I\n{t}\nQUY CHẾ\nkèm theo Quyết định 1\nPHỤ LỤC II\nx\nMục lục", ["main,0,"] + ["appendix,1,"] * 4 + ["appendix,2,"] * 3),
    ("Mục lục\nĐiều 1. A\n{t}\nb\nMục  lục\nĐiều 1\nPhụ lục I", ["main,0,"] * 4 + ["contents,0,"] * 3),
    ("QUY ĐỊNH\n{t}\na\nb\nkèm theo Luật này\nĐiều 1. A\nQuy chế\nkèm theo Luật này\nCHUẨN MỰC SỐ 1\nĐiều 2. B\nkèm theo Luật này", ["main,0,"] * 11),
]
PART_ROWS = ", ".join(f"({k}, {i}, '{p}')" for k, (_, ps) in enumerate(PARTS) for i, p in enumerate(ps))


@query(f"WITH v(k, line_no, part) AS (VALUES {PART_ROWS}), l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS line_no FROM (SELECT doc_id, string_split({T.sql([t for t, _ in PARTS])}, chr(10)) AS x FROM {T.FROM_SQL})) SELECT doc_id, line_no, string_split(part, ',')[1] AS owner, string_split(part, ',')[2]::BIGINT AS scope, nullif(string_split(part, ',')[3], '') AS kind, md5(line) AS line FROM l JOIN v USING (line_no) WHERE k = doc_id % {len(PARTS)}")
def ing3_owned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ING3 whole, WIN11: attached instruments, appendices and contents lists as owners of a source's lines."""
    lines = outline_parser.owned_lines(T.rows(spark, sf_dir, text=[t for t, _ in PARTS]))
    return lines.select("doc_id", "line_no", "owner", "scope", "kind", F.md5(F.col("line").cast("binary")).alias("line"))
