"""Document fingerprints by spot signatures.

A spot signature is a common word and the chain of CHAIN content words (all words that are not common) that follow it; at the
end of a text a chain may be shorter, but holds one word at least. A document's fingerprint is the set of its signatures, each
as a code of CODE_HEX hexadecimal digits of its MD5; two fingerprints are compared by Jaccard similarity. Words are runs of letters
and digits in lower case. A text without any such chain (a language whose common words are not in COMMON, a list of names)
has a chain at every word instead, of CHAIN words or of all if there are fewer. Only column functions are used.

``near_pairs`` joins a corpus with itself. Equal sets are one class. Classes are partitioned by set length: band b holds the lengths
whose logarithm to the base 1 / least is in [b, b + 1), so sets of a similarity of at least ``least`` are in one band or in
neighbouring ones. There, classes meet that share one of the codes that each must show (of n codes n - ceil(least * n) + 1, the rare
ones first), pairs whose lengths cannot reach ``least`` are pruned, and what is left is compared in full. Every pair of different
sets that is near enough is a row, so a group of m near but different sets has up to m * m / 2 rows.

Nulls: a null text is empty; rows with a null doc_id follow all others, by a hash of the text. Empty texts, and texts without
words, have the empty fingerprint; it is like itself (1) and like no other (0). Ties: rows with one doc_id follow each other by a
hash of the text. Repeated rows are documents of their own: one copy follows the other. Very long texts: all of the work on a text
is linear in its length, within one task. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.frames import NO_ID, saved, small_batches
from noticeflow.sources.readers import with_rank

CHAIN, CODE_HEX, LEAST = 3, 12, 0.75
MOST_FREQUENT = 4096  # codes that are more than this part of all are known to the driver
#: Common words of English, German, Spanish and French.
COMMON = (
    "a an and are as at be been but by can do for from had has have he her his i if in is it its my no not of on or she so that the their them there they this to was we were what when which who will with would you your "
    "als am auf aus bei bin da das dass dem den der des die du durch ein eine einem einen einer er es für hat haben ich ihr im ist mit nach nicht noch nur oder sein sich sie sind so um und uns vom von vor war was wie wir zu zum zur "
    "al como con cuando de del desde donde el ella en entre era esta este ha hay la las le les lo los más mi muy ni o para pero por porque que se sin sobre son su sus también un una y ya "
    "au aux avec ce ces cette comme dans elle est et il ils je leur lui mais même ne nous on ou où par pas plus pour qu qui sa ses si sont sur tout une vous"
).split()


def _let(value: str, name: str, body: str) -> str:
    """SQL of body in which name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def chains(text: str, common: Sequence[str] = COMMON, chain: int = CHAIN) -> str:
    """SQL of the signatures of a text (SQL as well), as strings, repeated as often as they occur.

    The common word that is number j of its kind, at word p, has p - j content words before it: that is where its chain begins
    among the content words.
    """
    listed = ", ".join("'" + w.replace("'", "\\'") + "'" for w in common)
    one = ", ".join(["get(w, p)", *(f"get(c, p - j + {k})" for k in range(chain))])
    spots = f"filter(transform(w, (x, i) -> if(x IN ({listed}), i, -1)), i -> i >= 0)"
    at_common = _let(f"filter(w, x -> x NOT IN ({listed}))", "c", _let(spots, "s", f"filter(transform(s, (p, j) -> if(p - j < size(c), concat_ws(' ', {one}), null)), x -> x IS NOT NULL)"))
    following = ", ".join(f"get(w, i + {k})" for k in range(chain))
    everywhere = f"transform(slice(w, 1, greatest(size(w) - {chain - 1}, least(size(w), 1))), (x, i) -> concat_ws(' ', {following}))"
    words = f"filter(split(lower({text}), r'[^\\p{{L}}\\p{{N}}]+'), x -> x != '')"
    return _let(words, "w", _let(at_common, "found", f"if(size(found) > 0, found, {everywhere})"))


def codes(text: str, common: Sequence[str] = COMMON, chain: int = CHAIN) -> Column:
    """The fingerprint of a column as a sorted array of different numbers."""
    return F.expr(f"sort_array(array_distinct(transform({chains(text, common, chain)}, x -> CAST(conv(substr(md5(CAST(x AS binary)), 1, {CODE_HEX}), 16, 10) AS bigint))))")


def printed(codes: Column) -> Column:
    """The fingerprint as a string: CODE_HEX lowercase digits a signature, in order."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), CODE_HEX, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprints; 1 for two empty ones. Sets of which one is empty are not intersected."""
    jaccard = _let(f"size(array_intersect({a}, {b}))", "n", f"n / (size({a}) + size({b}) - n)")
    return F.expr(f"CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN CAST(size({a}) = size({b}) AS double) ELSE {jaccard} END")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, codes and set_id of every document; documents of equal sets have one set_id."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.select("doc_id", codes("text").alias("codes")).withColumn("set_id", F.xxhash64("codes"))


def near_pairs(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """set_id of two classes (a, b), and their similarity, where it is at least ``least``; prints as fingerprinted() gives them."""
    sets = saved(prints.where(F.size("codes") > 0).groupBy("set_id").agg(F.first("codes").alias("codes")).withColumn("n", F.size("codes")))
    each = sets.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df"))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = [r["code"] for r in each.where(F.col("df") > total / MOST_FREQUENT).orderBy("df", "code").collect()]  # fewer than MOST_FREQUENT
    listed = F.array(*map(F.lit, often)).cast("array<bigint>")
    must = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1
    band = F.floor(F.log(F.col("n")) / -math.log(least) + 1e-9)
    shown = sets.select("set_id", "n", band.alias("band"), F.explode(F.slice(F.concat(F.array_except("codes", listed), F.array_intersect(listed, "codes")), F.lit(1), must)).alias("code"))
    left = shown.select("code", "band", F.col("set_id").alias("a"), F.col("n").alias("n_a"))
    right = shown.select("code", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("band").alias("own"), F.col("set_id").alias("b"), F.col("n").alias("n_b"))
    fits = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-9) & ((F.col("own") > F.col("band")) | (F.col("a") < F.col("b")))
    met = left.join(right, ["code", "band"]).where(fits).select("a", "b").distinct()
    first, second = (sets.select(F.col("set_id").alias(x), F.col("codes").alias(f"codes_{x}")) for x in "ab")
    return met.join(first, "a").join(second, "b").select("a", "b", likeness("codes_a", "codes_b").alias("similarity")).where(F.col("similarity") >= least)


def succession(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, text, edited (the last fourth of the text replaced by as much of the beginning of the next document),
    codes and next_codes of every document, next being the next in ascending doc_id, and the first after the last.

    Only keys and lengths are ranked. Each document then sends the beginning that its predecessor needs, and its codes, to that
    one's key; texts are dealt once, equal rows combined before that. Rows that are equal in id and text are ranked as one with a
    count: all but the last of them are followed by their like.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("text", F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_th"), F.col("doc_id").isNull().alias("_none"))
    key = ["_id", "_none", "_th"]
    ranked = with_rank(rows.groupBy(*key).agg(F.count("*").alias("copies"), F.first(F.length("text")).alias("n_chars")), *key, name="rank")
    total = ranked.count()
    before = ranked.select(F.pmod(F.col("rank") + 1, F.lit(max(1, total))).alias("rank"), *(F.col(c).alias(f"prior{c}") for c in key), F.floor(F.col("n_chars") / 4).cast("int").alias("asked"))
    places = ranked.join(before.hint("shuffle_merge"), "rank").drop("rank")

    unique = rows.groupBy(*key).agg(F.first("text").alias("text"))
    whole = unique.join(places.hint("shuffle_merge"), key)
    sent = whole.select(*(F.col(f"prior{c}").alias(c) for c in key), F.substr("text", F.lit(1), F.col("asked")).alias("head"), codes("text").alias("next_codes"))
    met = whole.drop("asked", *(f"prior{c}" for c in key)).join(sent.hint("shuffle_merge"), key)

    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edit = lambda head: F.concat(F.substr("text", F.lit(1), F.col("n_chars") - cut), F.substr(head, F.lit(1), cut))
    last = F.struct(edit(F.col("head")).alias("edited"), F.col("next_codes").alias("next_codes"), F.lit(1).cast("long").alias("times"))
    own = F.struct(edit(F.col("text")).alias("edited"), F.col("codes").alias("next_codes"), (F.col("copies") - 1).alias("times"))
    made = met.withColumn("codes", codes("text")).withColumn("_v", F.explode(F.when(F.col("copies") > 1, F.array(last, own)).otherwise(F.array(last))))
    return made.select(F.when(~F.col("_none"), F.col("_id")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "text", "_v.edited", "codes", "_v.next_codes", "_v.times")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like its own is to that and to the next document's."""
    met = succession(docs, id_col, text_col).withColumn("edited_codes", codes("edited"))
    made = met.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), printed(F.col("codes")).alias("fingerprint"), printed(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness("codes", "edited_codes").alias("near_edited"), likeness("codes", "next_codes").alias("near_next"), F.size("codes").cast("long").alias("n_codes"), "times",
    )
    return made.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_copy", "times")
