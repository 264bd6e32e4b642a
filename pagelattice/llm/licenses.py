"""License scans: TF-IDF cosine of notices to templates, then inheritance from the nearest directory. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.tables import pick, settled

# Names and notices of common licenses.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
]
# Fixed value: names of files that state the license of their directory.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.\-_][^/]*)?$"


def _tokens(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+"), lambda t: F.btrim(t, F.lit(".")) != "")


def notices(files: DataFrame, templates: DataFrame, percent: int = 75) -> DataFrame:
    """(path, license, score): the best matching notice of each file.

    A file's units are its lines, so a header is found wherever it stands, and for a license file (by name) also its whole text. The vectors
    are TF-IDF over the templates' words with frequencies counted over the units of all files; any other word of a unit counts as a word of its own
    that no unit has. Ties go to the license first in order. Frequencies, products and lengths are partial sums by key.
    """
    t = pick(templates, "license", "text").where("license IS NOT NULL AND text IS NOT NULL")
    tf = settled(t.select("license", F.explode(_tokens("text")).alias("token")).select("license", F.btrim("token", F.lit(".")).alias("token")).groupBy("license", "token").agg(F.count("*").alias("n")))
    vocabulary = tf.select("token").distinct()

    f = pick(files, "path", "text").where("path IS NOT NULL AND text IS NOT NULL")
    lines = f.select("path", F.posexplode(F.split("text", "\n")).alias("unit", "text"))
    whole = f.where(F.col("path").rlike(LICENSE_FILE)).select("path", F.lit(-1).alias("unit"), "text")
    units = lines.unionByName(whole).where(F.trim("text") != "").select("path", "unit", _tokens("text").alias("tokens")).where(F.size("tokens") > 0)
    total = units.count()
    words = units.select("path", "unit", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).select("path", "unit", "size", F.btrim("token", F.lit(".")).alias("token"))
    v = vocabulary.select(F.col("token").alias("v"))
    known = settled(words.join(v, F.col("token") == F.col("v")).groupBy("path", "unit", "token").agg(F.count("*").alias("n"), F.max("size").alias("size")))

    idf = lambda n: F.log((F.lit(float(total)) + 1) / (n + 1)) + 1
    weights = settled(v.join(known.groupBy("token").agg(F.count("*").alias("units")), F.col("v") == F.col("token"), "left").select("v", idf(F.coalesce("units", F.lit(0))).alias("idf")))
    unseen = idf(F.lit(0))
    template = tf.join(weights, F.col("token") == F.col("v")).select("license", F.col("token").alias("word"), (F.col("n") * F.col("idf")).alias("x"))
    lengths = template.groupBy("license").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length")).withColumnRenamed("license", "l")
    mine = known.join(weights, F.col("token") == F.col("v")).select("path", "unit", "size", "n", "token", (F.col("n") * F.col("idf")).alias("y"))
    own = mine.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("y") * F.col("y")) + (F.max("size") - F.sum("n")) * unseen * unseen).alias("own"))
    dots = mine.join(template, F.col("token") == F.col("word")).groupBy("path", "unit", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    o = own.select(F.col("path").alias("p"), F.col("unit").alias("u"), "own")
    scored = dots.join(lengths, F.col("license") == F.col("l")).join(o, (F.col("path") == F.col("p")) & (F.col("unit") == F.col("u")))
    scored = scored.select("path", "license", F.round(F.col("dot") / (F.col("length") * F.col("own")), 6).alias("score")).where(F.col("score") * 100 >= percent)
    best = scored.groupBy("path", "license").agg(F.max("score").alias("score")).groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def _directory(path: Column) -> Column:
    """The path without its last part; the top directory is the empty string."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def scan(files: DataFrame, templates: DataFrame, percent: int = 75, any_notice: bool = False) -> DataFrame:
    """(path, license, score, how, directory) of every distinct path.

    A file with a notice of its own has that license (how ``own``). Any other file inherits from the nearest directory above it that has one
    (``inherited``, ``directory`` says which), or has none (``none``, license null, score 0). A directory has the license of its license files, by name, or of
    any file with a notice where ``any_notice``; the best score counts, ties to the license first in order. Paths are
    joined on their ancestors, a row per level, and the deepest match is a partial maximum: a directory with a third of all
    files is never gathered. Null paths are left out, null and empty texts have no notice; texts of a repeated
    path are taken together.
    """
    found = settled(notices(files, templates, percent))
    declaring = found if any_notice else found.where(F.col("path").rlike(LICENSE_FILE))
    by = declaring.select(_directory(F.col("path")).alias("dir"), "license", "score").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    by = settled(by.select("dir", F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score")))

    every = pick(files, "path").where("path IS NOT NULL").distinct()
    mine = found.select(F.col("path").alias("p"), "license", "score")
    every = settled(every.join(mine, F.col("path") == F.col("p"), "left").drop("p"))
    parts = F.split(_directory(F.col("path")), "/")
    level = F.explode(F.sequence(F.lit(0), F.size(parts))).alias("level")
    above = every.where("license IS NULL").select("path", parts.alias("parts"), level).select("path", "level", F.array_join(F.slice("parts", 1, F.col("level")), "/").alias("above"))
    nearest = above.join(by, F.col("above") == F.col("dir")).groupBy("path").agg(F.max(F.struct("level", "dir", "dir_license", "dir_score")).alias("b"))
    nearest = nearest.select(F.col("path").alias("q"), "b.dir", "b.dir_license", "b.dir_score")
    out = every.join(nearest, F.col("path") == F.col("q"), "left")
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.coalesce("license", "dir_license").alias("license"), F.coalesce("score", "dir_score", F.lit(0.0)).alias("score"), how.alias("how"), F.when(how == "inherited", F.col("dir")).alias("directory"))


def page_files(pages: DataFrame) -> DataFrame:
    """(path, text) of web pages: the path is the host from its last label to its first, then the URL's path; tags become line breaks."""
    p = pick(pages, "url", "html")
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[?#].*$", "")
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(bare, r"^[^/]*", 0)), r"\.")), "/")
    path = F.concat(host, F.regexp_replace(F.regexp_replace(bare, r"^[^/]*", ""), r"/+$", ""))
    text = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", "\n")
    return p.select(path.alias("path"), text.alias("text"))
