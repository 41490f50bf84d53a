"""Table analytics over tables(filename, pos, cells): a row for each line of a table, cells an array of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import clean_value, has_any, strip_html, trim


def html_cells(html: Column) -> Column:
    """Rows of cells of an HTML table; rows without cells are dropped, tags stripped and entities decoded."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(0))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(0)), strip_html))
    return F.filter(cells, lambda r: F.size(r) > 0)


def to_csv(rows: Column) -> Column:
    """CSV text of rows of cells; cells with a comma, quote or line end are quoted."""
    quote = lambda c: F.when(c.rlike('[,\n"]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, quote), ",")), "\n")


def csv_cells(line: Column) -> Column:
    """Cells of a line: commas outside quotes part them, doubled quotes inside are one, each is trimmed."""
    pieces = F.split(line, '"')
    last = F.size(pieces) - 1
    numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))

    def step(cells: Column, x: Column) -> Column:
        # even pieces stand outside quotes; an empty one between two quoted ones is a doubled quote
        outside = x["i"] % 2 == 0
        doubled = outside & (x["i"] > 0) & (x["i"] < last) & (x["p"] == "")
        parts = F.when(doubled, F.array(F.lit('"'))).when(outside, F.split(x["p"], ",")).otherwise(F.array(x["p"]))
        joined = F.concat(F.element_at(cells, -1), parts[0])
        return F.concat(F.slice(cells, 1, F.size(cells) - 1), F.array(joined), F.slice(parts, F.lit(2), F.size(parts)))

    return F.transform(F.aggregate(numbered, F.array(F.lit("")), step), trim)


def catalog(tables: DataFrame) -> DataFrame:
    """(filename, table_number, name), by name."""
    parts = F.split(F.replace(F.col("filename"), F.lit(".csv"), F.lit("")), "_")
    name = F.array_join(F.slice(parts, 3, F.size(parts)), " ")
    return tables.select("filename").distinct().select("filename", F.try_element_at(parts, F.lit(2)).try_cast("int").alias("table_number"), name.alias("name"))


def lookup(files: DataFrame, number: int | None = None, keyword: str | None = None, section: str | None = None) -> DataFrame:
    """(filename, section, description) of a catalogue's files whose name holds all that is given."""
    low = F.lower("filename")
    out = files
    if number:
        out = out.where(F.col("filename").contains(f"table_{number:03d}"))
    if keyword:
        out = out.where(low.contains(keyword.lower()))
    if section:
        out = out.where(low.contains("_".join(section.lower().split())))
    return out.select("filename", F.when(F.col("name") == "", "Unknown").otherwise(F.col("name")).alias("section"), F.concat(F.lit("Table "), F.col("table_number").cast("string"), F.lit(": "), F.col("name")).alias("description"))


def select_tables(files: DataFrame, number: int | None = None, keyword: str | None = None, most: int = 3) -> DataFrame:
    """The first `most` files by name; for a financial keyword files on operations come first, then financial ones."""
    found = lookup(files, number, keyword).select("filename")
    rank = F.lit(0)
    if keyword and any(k in keyword.lower() for k in vocab.PRIORITY_KEYWORDS):
        rank = F.when(F.col("filename").contains("operations"), 2).when(F.col("filename").contains("financial"), 1).otherwise(0)
    return found.withColumn("priority", rank).orderBy(F.desc("priority"), "filename").limit(most)


def year_columns(tables: DataFrame) -> DataFrame:
    """(filename, col, year, seq): the first year in the first four lines of each column, in the order found; col from 0."""
    cells = tables.where("pos < 4").select("filename", "pos", F.posexplode("cells").alias("col", "cell"))
    years = cells.withColumn("year", F.regexp_extract("cell", r"\b(20[0-9]{2})\b", 1)).where("year <> ''")
    first = years.groupBy("filename", "col").agg(F.min(F.struct("pos", "year")).alias("f"))
    order = Window.partitionBy("filename").orderBy("f.pos", "col")
    return first.select("filename", "col", F.col("f.year").alias("year"), F.row_number().over(order).alias("seq"))


def infer_years(tables: DataFrame, as_of_year: int, hints: dict[str, list[str]] | None = None) -> DataFrame:
    """(filename, col, year, seq) for tables without years: columns of revenue rows whose figure holds all parts of a hint, else columns 1 to 4 as this year and those before."""
    out = None
    if hints:
        rev = tables.where(F.lower(F.try_element_at("cells", F.lit(1))).contains("revenue")).select("filename", "pos", F.posexplode("cells").alias("col", "cell")).where("col > 0")
        value = clean_value(F.col("cell"))
        case = F.lit(None).cast("string")
        for year, parts in reversed(list(hints.items())):
            ok = F.lit(True)
            for p in parts:
                ok = ok & value.contains(p)
            case = F.when(ok, year).otherwise(case)
        out = rev.withColumn("year", case).where("year IS NOT NULL").select("filename", "col", "year", F.row_number().over(Window.partitionBy("filename").orderBy("pos", "col")).alias("seq"))
    width = tables.where("pos = 0").select("filename", F.size("cells").alias("n")).where("n > 1")
    if out is not None:
        width = width.join(out.select("filename").distinct(), "filename", "left_anti")
    plain = width.select("filename", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - 1, F.lit(4)))).alias("col")).select("filename", "col", (F.lit(as_of_year + 1) - F.col("col")).cast("string").alias("year"), F.col("col").alias("seq"))
    return plain if out is None else out.unionByName(plain)


def years(tables: DataFrame, as_of_year: int, hints: dict[str, list[str]] | None = None) -> DataFrame:
    """Years found, and for tables without any those inferred."""
    found = year_columns(tables)
    return found.unionByName(infer_years(tables.join(found.select("filename").distinct(), "filename", "left_anti"), as_of_year, hints))


def headers(tables: DataFrame, year_cols: DataFrame) -> DataFrame:
    """(filename, headers, data_start): the first of three lines that speaks of a period, years added; else a line made of the years."""
    by_col = year_cols.groupBy("filename").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", "year")))).alias("years"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "year"))), lambda x: F.concat(F.lit("Year "), x["year"])).alias("plain"))
    speaks = F.exists("cells", lambda c: c.rlike("(?i)year|ended|months|quarter"))
    lines = tables.where("pos < 3").where(speaks).groupBy("filename").agg(F.min_by("cells", "pos").alias("line"), F.min("pos").alias("pos"))
    dated = by_col.join(lines, "filename", "left").select(
        "filename",
        F.when(F.col("line").isNotNull(), F.transform("line", lambda c, i: F.coalesce(F.concat(c, F.lit(" ("), F.try_element_at("years", i), F.lit(")")), c))).otherwise(F.concat(F.array(F.lit("Description")), "plain")).alias("headers"),
        F.coalesce(F.col("pos") + 1, F.lit(0)).cast("int").alias("data_start"),
    )
    # tables of a single column have no years
    first = F.exists("cells", lambda c: c.rlike("(?i)[0-9]{4}|quarter|year|ended"))
    undated = tables.where("pos < 2").where(first).join(by_col, "filename", "left_anti").groupBy("filename").agg(F.min_by("cells", "pos").alias("headers"), (F.min("pos") + 1).cast("int").alias("data_start"))
    return dated.unionByName(undated)


def row_filter(tables: DataFrame, text: str) -> DataFrame:
    return tables.where(F.exists("cells", lambda c: F.lower(c).contains(text.lower())))


def year_pivot(tables: DataFrame, year_cols: DataFrame) -> DataFrame:
    """(filename, pos, row_label, year, value): cleaned figures of labelled lines; the later column of a year wins."""
    cells = tables.where((F.size("cells") > 1) & (trim(F.col("cells")[0]) != "")).select("filename", "pos", F.col("cells")[0].alias("row_label"), F.posexplode("cells").alias("col", "cell"))
    return cells.join(year_cols, ["filename", "col"]).groupBy("filename", "pos", "row_label", "year").agg(F.max_by(clean_value(F.col("cell")), "seq").alias("value"))


def read_table(tables: DataFrame, as_of_year: int, number: int | None = None, keyword: str | None = None, row_text: str | None = None, hints: dict[str, list[str]] | None = None) -> DataFrame:
    """(filename, table_number, description, pos, row_label, values, year_data) of the selected tables' data lines."""
    files = select_tables(catalog(tables), number, keyword)
    mine = tables.join(F.broadcast(files.select("filename")), "filename")
    cols = years(mine, as_of_year, hints)
    body = mine.join(headers(mine, cols).select("filename", "data_start"), "filename", "left").where(F.col("pos") >= F.coalesce("data_start", F.lit(0)))
    body = row_filter(body, row_text) if row_text else body
    by_year = year_pivot(body, cols).groupBy("filename", "pos").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("year", "value")))).alias("year_data"))
    rows = body.where((F.size("cells") > 1) & (trim(F.col("cells")[0]) != "")).join(by_year, ["filename", "pos"], "left")
    return rows.join(catalog(tables), "filename").select("filename", "table_number", F.when(F.col("name") == "", "Financial Table").otherwise(F.col("name")).alias("description"), "pos", F.col("cells")[0].alias("row_label"), F.transform(F.slice("cells", 2, F.size("cells")), clean_value).alias("values"), "year_data")


def summary(tables: DataFrame, keyword: str, as_of_year: int) -> DataFrame:
    """One line: tables found and, for a revenue keyword, the first revenue row of the first table by year."""
    files = select_tables(catalog(tables), None, keyword).join(catalog(tables), "filename")
    listed = files.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("priority")).alias("p"), "filename", "table_number", "name"))), lambda x: F.concat(F.lit("Table "), x["table_number"].cast("string"), F.lit(": "), x["name"])), ", ").alias("names"), F.min(F.struct((-F.col("priority")).alias("p"), "filename")).alias("first"))
    line = listed.where("n > 0").withColumn("summary", F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(f' table(s) matching "{keyword}": '), F.col("names")))
    if "revenue" not in keyword.lower():
        return line.select("summary")
    rows = read_table(tables, as_of_year, keyword=keyword)
    rows = rows.where(F.lower("row_label").contains("revenue") & ~F.lower("row_label").contains("cost"))
    first = rows.join(listed.select(F.col("first.filename").alias("filename")), "filename").groupBy("filename").agg(F.min_by("year_data", "pos").alias("year_data"))
    by_year = first.select(F.concat(F.lit(". Revenue by year: "), F.array_join(F.transform(F.array_sort(F.map_entries("year_data")), lambda e: F.concat(e["key"], F.lit(": $"), e["value"])), ", ")).alias("more"))
    return line.join(by_year, how="left").select(F.concat("summary", F.coalesce("more", F.lit(""))).alias("summary"))


def describe(filename: Column, section: Column, caption: Column) -> Column:
    """A table's caption, else a description by its file's name, else by its section."""
    low, sec = F.lower(filename), F.lower(section)
    out = F.concat(F.lit("Data table from "), section, F.lit(" section"))
    for word, text in reversed(vocab.SECTION_DESCRIPTIONS):
        out = F.when(sec.contains(word), F.lit(text)).otherwise(out)
    for words, text in reversed(vocab.TABLE_DESCRIPTIONS):
        out = F.when(has_any(low, words), F.lit(text)).otherwise(out)
    return F.when(F.size(caption) > 0, F.array_join(caption, " ")).otherwise(out)


def growth(by_year: DataFrame, value: str) -> DataFrame:
    """by_year(year, value) with percent growth over the year before."""
    before = F.lag(value).over(Window.orderBy("year"))  # a row a year
    return by_year.withColumn("growth_pct", F.round((F.col(value) - before) / before * 100, 4))


def margin(gain: Column, total: Column) -> Column:
    return F.round(gain / total * 100, 4)
