"""Noise in text from scanned pages: page furniture, broken words, misread characters; detection and repair.

Furniture: a line between the lines that is a page number (its value is the page's), or a heading in capitals whose
letters recur on several pages, each time read with up to three edits. Then the lines are joined and broken words healed, and
misread letters are found against the vocabulary of the corpus itself: a rare word that
the usual confusions of scanners turn into a far more frequent one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernalex.functions.text import deaccent
from vernalex.plans.lineage import cut, small
from vernalex.sources.tables import first_deliveries, read

# Pages on which a heading stands at least, and edits between two readings of it.
HEADING_PAGES, HEADING_EDITS = 3, 3
# How many times as frequent the word meant must be.
RATIO = 12

# What scanners print for what; `print` is read as `meant`.
CONFUSIONS = (
    ("b", "h"), ("c", "e"), ("e", "c"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("rn", "m"), ("m", "rn"), ("n", "u"), ("u", "n"),
    ("li", "h"), ("h", "li"), ("l", "i"), ("i", "l"), ("t", "f"), ("f", "t"), ("tl", "d"), ("in", "m"), ("nn", "m"), ("o", "c"), ("c", "o"), ("s", "a"), ("h", "b"), ("d", "cl"), ("j", "i"), ("y", "v"), ("v", "y"), ("q", "g"), ("g", "q"), ("ll", "u"), ("u", "ll"), ("ſ", "s"),
)
# Marks and digits that stand for letters.
MARK_PAIRS = (("ſ", "s"), ("†", "t"), ("@", "a"), ("!", "i"), ("|", "l"), ("()", "o"), ("0", "o"), ("1", "l"), ("3", "e"), ("4", "a"), ("5", "s"), ("6", "b"), ("8", "b"), ("7", "t"), ("9", "g"), ("$", "s"), ("µ", "u"))
HYPHEN = "\\-\u2010\u00ac\u00ad"
# marks that no word contains
MARK = "[\u00ab\u00bb{}\\[\\]|\\\\~*\u2020\u2021@\ufffd<>^_=+%#$\u00a7\u017f\u00b5\u00a4\u00a6\u00b0\ufb00-\ufb06\u0370-\u04ff]"
OMISSION = r"\[[a-z ]+\]|\.{2,}|…|-{2,}|—"

SMALL_WORDS = "of|and|the|in|to|for|de|la|du|des"


def heading_like(line: Column) -> Column:
    """Two capitalised words or more, ten letters or more, and no other word in small letters than the little ones."""
    small = rf"(?<![\p{{L}}\d])(?!(?:{SMALL_WORDS}|[lIO0-9]{{1,4}})(?![\p{{L}}\d]))\p{{Ll}}\p{{L}}"
    # the test that most lines fail comes first
    return (
        ~line.rlike(small)
        & (F.length(line) >= 10)
        & (F.regexp_count(line, F.lit(r"\p{L}")) >= 10)
        & (F.regexp_count(line, F.lit(rf"(?<!\p{{L}})(?!(?:[lIO0-9]{{1,4}})(?![\p{{L}}\d]))\p{{Lu}}[\p{{L}}\d]+")) >= 2)
        & ~line.rlike(rf"[{HYPHEN}]\s*$")
    )


def skeleton(line: Column) -> Column:
    """Letters of a line in capitals, its page number aside."""
    return F.regexp_replace(F.upper(deaccent(F.regexp_replace(line, r"(?<![\p{L}\d])[lIO0-9]{1,4}(?![\p{L}\d])", ""))), "[^A-Z]", "")


def page_number(line: Column, page: Column, printed: Column) -> Column:
    """A line with nothing but the number of its page (l, I, O for digits), bare or between marks."""
    bare = F.regexp_extract(line, r"^[\s\W]*([0-9lIO]{1,4})[\s\W]*$", 1)
    value = F.translate(bare, "lIO", "110")
    return F.coalesce((value != "") & ((value == page.cast("string")) | (value == F.trim(printed))), F.lit(False))


def with_skeletons(texts: DataFrame) -> DataFrame:
    """Add ``_sk``: of a several-line text the skeleton of each heading-like line that doesn't begin with the printed headword, null for the others; null without any."""
    own = skeleton(F.col("own"))
    sk = F.transform(F.split("text", "\n"), lambda x: F.when(heading_like(x), skeleton(x)))
    sk = F.transform(sk, lambda k: F.when(own.isNull() | ~F.startswith(k, own), k))
    t = texts.withColumn("_sk", F.when(F.contains("text", F.lit("\n")), sk))
    return t.withColumn("_sk", F.when(F.size(F.array_compact("_sk")) > 0, F.col("_sk")))


def _piece_key(size: Column, j: int, piece: Column) -> Column:
    return F.concat_ws(":", size, F.lit(j), piece)


def _pieces(word: Column) -> Column:
    """Keys of HEADING_EDITS + 1 pieces of a skeleton; so many edits leave one of them whole."""
    n, k = F.length(word), HEADING_EDITS + 1
    place = [F.floor(n * j / k).cast("int") for j in range(k + 1)]
    return F.array(*[_piece_key(n, j, word.substr(place[j] + 1, place[j + 1] - place[j])) for j in range(k)])


def _probes(word: Column) -> Column:
    """Keys of the pieces that a skeleton within HEADING_EDITS can have in common with this one, for every length and shift it can have."""
    n, k, e = F.length(word), HEADING_EDITS + 1, HEADING_EDITS
    keys = []
    for more in range(-e, e + 1):
        size = n - more
        for j in range(k):
            start, end = F.floor(size * j / k).cast("int"), F.floor(size * (j + 1) / k).cast("int")
            for shift in range(-e, e + 1):
                if abs(shift) + abs(more - shift) <= e:
                    at = start + shift
                    keys.append(F.when((at >= 0) & (at + end - start <= n), _piece_key(size, j, word.substr(at + 1, end - start))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _alike(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """(sk, n, other, n_other) of skeletons within HEADING_EDITS; an equi-join on pieces, never by broadcast, as the pieces are far more than the skeletons."""
    a = asked.select("sk", "n", F.explode(_probes(F.col("sk"))).alias("k"))
    b = listed.select(F.col("sk").alias("other"), F.col("n").alias("n_other"), F.explode(_pieces(F.col("sk"))).alias("k")).hint("merge")
    return a.join(b, "k").where(F.levenshtein("sk", "other", HEADING_EDITS) >= 0).select("sk", "n", "other", "n_other").distinct()


def headings(lines: DataFrame) -> DataFrame:
    """(sk) skeletons that stand on HEADING_PAGES pages or more (lines: sk, volume_id, page), and what is within HEADING_EDITS of one; of the
    rest those that do so together with the ones alike.

    So a header misread in another way on each page is found as well. Nothing is listed on the driver; each page counts once for a skeleton.
    """
    once = cut(lines.distinct().groupBy("sk").agg(F.count("*").alias("n")))
    often = once.where(F.col("n") >= HEADING_PAGES)
    seldom = once.where(F.col("n") < HEADING_PAGES)
    near = cut(_alike(seldom, often).select("sk").distinct())
    rest = cut(seldom.join(near, "sk", "left_anti"))
    among = cut(_alike(rest, rest))
    core = among.groupBy("sk").agg(F.sum("n_other").alias("_n")).where(F.col("_n") >= HEADING_PAGES).select(F.col("sk").alias("other"))
    return often.select("sk").unionByName(near).unionByName(among.join(core, "other").select("sk").distinct())


def mark_furniture(texts: DataFrame) -> DataFrame:
    """Add ``body`` (text without furniture lines, line ends kept) and ``furniture`` (whether there were any).

    texts: part, seq (unique together), volume_id, page, printed_page, text, own. The lines of the texts are learnt from and judged at once, so that
    a heading is found by an exact join; only the few texts with a heading-like line take part in it.
    """
    t = cut(with_skeletons(texts))
    lines = t.where(F.col("_sk").isNotNull()).select("part", "seq", "volume_id", "page", F.posexplode("_sk").alias("at", "sk")).where(F.col("sk").isNotNull())
    heads = lines.join(headings(lines.select("sk", "volume_id", "page")), "sk").groupBy("part", "seq").agg(F.collect_set("at").alias("_heads"))
    few = t.where(F.col("_sk").isNotNull()).join(heads, ["part", "seq"], "left")
    t = few.unionByName(t.where(F.col("_sk").isNull()).withColumn("_heads", F.lit(None).cast("array<int>")))
    split = F.split("text", "\n")
    kept = F.filter(split, lambda x, i: ~(page_number(x, F.col("page"), F.col("printed_page")) | F.coalesce(F.array_contains("_heads", i), F.lit(False))))
    t = t.withColumn("_kept", F.when(F.contains("text", F.lit("\n")), kept))
    return t.withColumns({
        "furniture": F.coalesce(F.size("_kept") < F.size(split), F.lit(False)),
        "body": F.coalesce(F.array_join("_kept", "\n"), "text"),
    }).drop("_kept", "_heads", "_sk")


# A word broken at a line end, kept (a) or lost to blanks (b); not a suspended hyphen before "to" or "or".
BROKEN_LINE = rf"(\p{{L}})[{HYPHEN}][ \t]*\n\s*(?!(?:to|or)\b)(?=[\p{{L}}\p{{Sc}}\W\d]?\p{{L}})"
BROKEN_BLANK = rf"(\p{{L}})[{HYPHEN}][ \t]+(?!(?:to|or)\b)(?=\p{{Ll}})"
SOFT = r"(\p{L})[\u00ac\u00ad\u2010](?=\p{L})"


def broken(body: Column) -> Column:
    return body.rlike(rf"[{HYPHEN}]\s|[\u00ac\u00ad\u2010]") & (body.rlike(BROKEN_LINE) | body.rlike(BROKEN_BLANK) | body.rlike(SOFT))


def healed(body: Column) -> Column:
    """Broken words joined; a compound broken at its own hyphen is joined as well, its hyphen being lost in the break."""
    x = F.regexp_replace(F.regexp_replace(body, BROKEN_LINE, "$1"), BROKEN_BLANK, "$1")
    return F.when(body.rlike(rf"[{HYPHEN}]\s|[\u00ac\u00ad\u2010]"), F.regexp_replace(x, SOFT, "$1")).otherwise(body)


def compound_kept(body: Column, own: Column) -> Column:
    """A compound headword broken at its own hyphen gets it back on one line."""
    first = rf"^([^,;(\n]*\p{{Lu}})[{HYPHEN}][ \t]*\n\s*(?=\p{{Lu}})"
    return F.when(F.contains(own, F.lit("-")) & body.rlike(first), F.regexp_replace(body, first, "$1-")).otherwise(body)


# A mark or digit within, at the start or at the end of a word.
MARKED = rf"\p{{L}}{MARK}|{MARK}\p{{L}}|\p{{L}}\d|\d\p{{L}}|\p{{L}}\(\)|\(\)\p{{L}}|\p{{L}}!\p{{L}}|(?<![\p{{L}}!])!\p{{L}}|\p{{L}}[.,;:]\p{{Ll}}\p{{Ll}}"
# What every text with such a mark or digit holds; one look at each letter tells most texts that have none.
MAYBE_MARKED = rf"{MARK[:-1]}\d!]|\(\)|[.,;:]\p{{Ll}}\p{{Ll}}"


def marked(text: Column) -> Column:
    """A mark or digit stands within, at the start or at the end of a word; marks of omission and ordinals are none."""
    t = F.regexp_replace(text, OMISSION, " ")
    t = F.regexp_replace(t, r"(?<![\p{L}\d])\d+(?:st|nd|rd|th)(?![\p{L}\d])", " ")
    return text.rlike(MAYBE_MARKED) & text.rlike(MARKED) & t.rlike(MARKED)


def marked_head(head: Column) -> Column:
    """Anything but capitals, blanks and hyphens within a headword; a quote before it is none."""
    h = F.regexp_replace(F.trim(head), r"^['‘’\"`]+|['’\"?]+$", "")
    return h.rlike(r"[^\p{Lu}\s\-]")


def words_of(body: Column) -> Column:
    """Lower-case words of a healed text, marks within them kept, outer punctuation gone."""
    t = F.regexp_replace(F.lower(body), r"[\s\-—]+", " ")
    return F.filter(F.transform(F.split(t, " "), lambda w: F.regexp_replace(w, r"^[.,;:'\"?]+|[.,;:'\"?!]+$|^\((?!\))|(?<!\()\)$", "")), lambda w: w != "")


def _swaps(w: Column, pairs: tuple) -> Column:
    """All words that one confusion turns the word into: at all its places, and, where there are several, at the first or the last."""
    each = [w]
    for a, b in pairs:
        everywhere = F.replace(w, F.lit(a), F.lit(b))
        each.append(everywhere)
        several = F.length(w) - F.length(F.replace(w, F.lit(a), F.lit(""))) > len(a)
        q = re.escape(a)
        each.append(F.when(several, F.regexp_replace(w, rf"^(.*?){q}(.*)$", rf"$1{b}$2")))
        each.append(F.when(several, F.regexp_replace(w, rf"^(.*){q}(.*?)$", rf"$1{b}$2")))
    return F.array_distinct(F.array_compact(F.array(*each)))


def _unmarked(w: Column) -> Column:
    """The word with every mark and digit read as the letter it mostly stands for."""
    for a, b in MARK_PAIRS:
        w = F.replace(w, F.lit(a), F.lit(b))
    return w


def misread_words(counts: DataFrame, marks: bool = True) -> DataFrame:
    """counts(word, n) -> (word, meant): words that a confusion turns into one at least RATIO times as frequent.

    With ``marks`` words that hold marks or digits are read too, and an undecodable letter may be any.
    """
    plain = counts.where(~F.col("word").rlike(r"[^\p{L}]") & ~F.contains("word", F.lit("ſ")))
    frequent = plain.where(F.col("n") >= RATIO).select(F.col("word").alias("meant"), F.col("n").alias("n_meant"))
    # a confusion at most doubles or halves a word, so longer ones can't become a frequent word
    longest = frequent.agg(F.max(F.length("meant")).alias("_longest"))
    rare = (counts if marks else plain).where(F.length("word") >= 2).crossJoin(F.broadcast(longest)).where(F.length("word") <= 2 * F.col("_longest")).drop("_longest")
    forms = rare.select("word", "n", F.explode(_swaps(_unmarked(F.col("word")) if marks else F.col("word"), CONFUSIONS)).alias("v")).where(F.col("v") != F.col("word"))
    hit = forms.join(frequent, forms["v"] == frequent["meant"]).where(F.col("n_meant") >= F.col("n") * RATIO).select("word", "meant", "n_meant")
    if marks:
        gaps = rare.where(F.contains("word", F.lit("\ufffd"))).select("word", F.regexp_replace("word", "\ufffd", "_").alias("v"))
        holes = frequent.select("meant", "n_meant", F.explode(F.transform(F.sequence(F.lit(1), F.length("meant")), lambda i: F.concat(F.substring("meant", F.lit(1), i - 1), F.lit("_"), F.substring("meant", i + 1, F.length("meant"))))).alias("v"))
        hit = hit.unionByName(gaps.join(holes, "v").select("word", "meant", "n_meant"))
    return hit.groupBy("word").agg(F.max_by("meant", F.struct("n_meant", "meant")).alias("meant"))


def fields(part1: DataFrame, part2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deduplicated texts of both parts: seq, volume_id, page, printed_page, text, own (the printed headword) and, of Part I, headword."""
    p1 = first_deliveries(part1, "seq", "volume_id", "page", "printed_page", "headword", "ocr_headword", F.col("raw").alias("text"))
    p1 = p1.withColumn("own", F.coalesce("ocr_headword", "headword")).drop("ocr_headword")
    p2 = first_deliveries(part2.where(F.col("notes").isNotNull()), "seq", "volume_id", "page", "printed_page", F.col("notes").alias("text"))
    return p1, p2.withColumn("own", F.lit(None).cast("string"))


def inspected(part1: DataFrame, part2: DataFrame) -> tuple[DataFrame, DataFrame]:
    p1, p2 = fields(part1, part2)
    both = p1.withColumn("part", F.lit(1)).unionByName(p2.withColumns({"part": F.lit(2), "headword": F.lit(None).cast("string")}))
    t = mark_furniture(both)
    return t.where("part = 1").drop("part"), t.where("part = 2").drop("part", "headword")


# A word in small letters after another one or after a stop: no name's epithet, as that follows its genus.
SMALL_WORD = r"(?<!\p{L})(?:\p{Ll}+[.,]?|\p{Lu}\p{L}+[.,])(?=\s+(\p{Ll}+)(?![\p{L}\d]))"


def flattened(p1: DataFrame) -> DataFrame:
    """Add ``flat``, the entry on one line with its broken words joined, ``has_head``, whether it begins with the printed headword, and ``rest``, what follows that."""
    own = F.trim("own")
    joined = healed(compound_kept(F.col("body"), own))
    p = p1.withColumn("flat", F.when(F.col("body").rlike(r"[\n\t]|  "), F.trim(F.regexp_replace(joined, r"\s+", " "))).otherwise(F.trim(joined)))
    p = p.withColumn("has_head", F.coalesce(F.startswith("flat", own) & (own != ""), F.lit(False)))
    return p.withColumn("rest", F.when(F.col("has_head"), F.expr("substring(flat, length(trim(own)) + 1)")).otherwise(F.col("flat")))


def misread_small_words(p: DataFrame) -> DataFrame:
    """(seq, word, meant) of flattened entries: words beside the names ("and other species") misread, by the words of all entries."""
    some = p.where(F.col("body").rlike(r"\s\p{Ll}[\p{Ll}.,]*\s+\p{Ll}|[.,]\s+\p{Ll}"))
    words = cut(some.select("seq", F.explode(F.array_distinct(F.regexp_extract_all("rest", F.lit(SMALL_WORD), F.lit(1)))).alias("word")))
    counts = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    return words.join(misread_words(counts, marks=False), "word").select("seq", "word", "meant")


def entry_damage(p1: DataFrame) -> DataFrame:
    """raw and headword: (seq, field_name, kind)."""
    body, rest = F.col("body"), F.col("rest")
    p = flattened(p1)
    chars = marked(rest) | (F.col("has_head") & marked_head(F.trim("own"))) | (~F.col("has_head") & rest.rlike(r"\p{Lu}\p{Lu}\p{Ll}"))
    joined = F.regexp_replace(rest, "-{2,}", " ")
    hyphen = broken(body) | (rest.rlike(rf"\p{{L}}[{HYPHEN}]") & joined.rlike(rf"\p{{L}}[{HYPHEN}]\p{{Ll}}"))
    raw = F.array_compact(F.array(F.when(F.col("furniture"), F.lit("furniture")), F.when(hyphen, F.lit("hyphen")), F.when(chars, F.lit("chars"))))
    head = F.array_compact(F.array(F.when(broken(F.col("headword")) | F.col("headword").rlike("\u00ac|\u00ad|\n"), F.lit("hyphen")), F.when(marked_head(F.col("headword")), F.lit("chars"))))
    each = F.array(F.struct(F.lit("raw").alias("field_name"), raw.alias("kinds")), F.struct(F.lit("headword").alias("field_name"), head.alias("kinds")))
    seen = p.select("seq", F.explode(each).alias("e")).select("seq", "e.field_name", F.explode("e.kinds").alias("kind"))
    read_wrong = misread_small_words(p).select("seq", F.lit("raw").alias("field_name"), F.lit("chars").alias("kind"))
    return seen.unionByName(read_wrong).distinct()


# Where a word is torn.
TORN = "\x01"


def torn(body: Column) -> Column:
    """The text with one TORN in place of each break of a word."""
    x = F.regexp_replace(F.regexp_replace(body, BROKEN_LINE, f"$1{TORN}"), BROKEN_BLANK, f"$1{TORN}")
    return F.when(body.rlike(rf"[{HYPHEN}]\s|[\u00ac\u00ad\u2010]"), F.regexp_replace(x, SOFT, f"$1{TORN}")).otherwise(body)


def _letter_words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))


def rejoined_notes(p2: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes with ``whole`` (broken words joined as the corpus writes them), ``broken`` (a word was) and ``lost`` (a line end was lost), their words and counts of these.

    Each break is decided by the notes that hold the word unbroken: with its hyphen if more have it so than joined, else joined. A hyphened word
    within a line is joined (its line end being lost) if RATIO times as many notes have it as one word. Words: (seq, word), of letters only;
    counts: (word, n). The notes are searched once, for breaks, words and hyphened words alike, and these are written with them.
    """
    p2 = p2.withColumn("_torn", torn(F.col("body")))
    p2 = p2.withColumn("_text", F.lower("_torn"))
    has_torn = F.contains("_text", F.lit(TORN))
    # the patterns try every end of a word, so only texts with a break are searched for one
    p2 = p2.withColumn("_solid", F.when(has_torn, F.regexp_replace("_text", rf"[\p{{L}}\-]*{TORN}[\p{{L}}\-{TORN}]*", " ")).otherwise(F.col("_text")))
    pairs = F.when(has_torn, F.regexp_extract_all("_text", F.lit(rf"(\p{{L}}+{TORN}\p{{L}}+)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    broken_forms = F.transform(F.array_distinct(pairs), lambda c: F.struct(F.replace(c, F.lit(TORN), F.lit("-")).alias("c"), F.lit(True).alias("torn")))
    compounds = F.transform(F.array_distinct(F.regexp_extract_all("_solid", F.lit(r"(?<![\p{L}\-])(\p{L}+-\p{L}+)(?![\p{L}\-])"), F.lit(1))), lambda c: F.struct(c.alias("c"), F.lit(False).alias("torn")))
    p2 = p2.withColumns({
        "_words": _letter_words(F.col("_solid")),
        "_forms": F.when(F.col("body").rlike(rf"[{HYPHEN}]"), F.concat(broken_forms, compounds)),
        "_torn": F.when(F.col("_torn") != F.col("body"), F.col("_torn")),
    })
    p2 = cut(p2.drop("_text", "_solid"))
    words = p2.select("seq", F.explode("_words").alias("word"))
    counts = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    forms = p2.select("seq", F.explode("_forms").alias("f")).select("seq", "f.*")
    often = forms.groupBy("c").agg(F.count_if(~F.col("torn")).alias("n_c"), F.max("torn").alias("_any")).withColumn("word", F.replace("c", F.lit("-"), F.lit("")))
    n, n_c = F.coalesce("n", F.lit(0)), F.col("n_c")
    judged = often.join(counts, "word", "left").select("c", (F.col("_any") & (n_c > n)).alias("keep"), ((n_c > 0) & (n >= n_c * RATIO)).alias("join"))
    judged = judged.where(F.col("keep") | F.col("join"))
    changed = forms.join(judged, "c").where(F.when(F.col("torn"), F.col("keep")).otherwise(F.col("join")))
    changed = changed.groupBy("seq").agg(F.collect_list(F.struct("c", "torn")).alias("_changes"))
    # only notes with a hyphen take part in the join
    few = p2.where(F.col("_forms").isNotNull()).join(changed, "seq", "left")
    p2 = few.unionByName(p2.where(F.col("_forms").isNull()).withColumn("_changes", F.lit(None).cast(few.schema["_changes"].dataType)))

    def change(t: Column, f: Column) -> Column:
        a, b = F.substring_index(f["c"], "-", 1), F.substring_index(f["c"], "-", -1)
        kept = F.regexp_replace(t, F.concat(F.lit(r"(?iu)(?<!\p{L})("), a, F.lit(f"){TORN}("), b, F.lit(r")(?!\p{L})")), F.lit("$1-$2"))
        joined = F.regexp_replace(t, F.concat(F.lit(r"(?iu)(?<![\p{L}\-])("), a, F.lit(")-("), b, F.lit(r")(?![\p{L}\-])")), F.lit("$1$2"))
        return F.when(f["torn"], kept).otherwise(joined)

    marked_breaks = F.coalesce("_torn", "body")
    decided = F.when(F.col("_changes").isNull(), marked_breaks).otherwise(F.aggregate("_changes", marked_breaks, change))
    p2 = p2.withColumns({"whole": F.replace(decided, F.lit(TORN), F.lit("")), "broken": F.col("_torn").isNotNull(), "lost": F.coalesce(F.exists("_changes", lambda f: ~f["torn"]), F.lit(False))})
    # words that stand only in what was rejoined
    p2 = cut(p2.withColumn("_more", F.when(F.col("broken") | F.col("lost"), F.array_except(_letter_words(F.col("whole")), F.col("_words")))).drop("_torn", "_words", "_forms", "_changes"))
    more = p2.select("seq", F.explode("_more").alias("word"))
    all_counts = counts.unionByName(more.groupBy("word").agg(F.count("*").alias("n"))).groupBy("word").agg(F.sum("n").alias("n"))
    return p2.drop("_more"), words.unionByName(more), all_counts


def note_words(p2: DataFrame) -> DataFrame:
    """(seq, word) distinct words of the rejoined notes."""
    return p2.select("seq", F.explode(F.array_distinct(words_of(F.col("whole")))).alias("word"))


def damage(part1: DataFrame, part2: DataFrame) -> DataFrame:
    """(src_table, seq, field_name, kind), one row per damaged field and kind.

    Null texts have no damage; an empty text has none; repeated deliveries of a seq count once.
    """
    p1, p2 = inspected(part1, part2)
    entries = entry_damage(p1).select(F.lit("part1_vernacular").alias("src_table"), "seq", "field_name", "kind")
    # words of letters only; what a mark splits is damaged anyway
    p2, words, counts = rejoined_notes(p2)
    wrong = small(misread_words(counts.where(F.length("word") > 0), marks=False).select("word"))
    sure = p2.select("seq", F.explode(F.array_compact(F.array(F.when(F.col("furniture"), F.lit("furniture")), F.when(F.col("broken") | F.col("lost"), F.lit("hyphen")), F.when(marked(F.col("whole")), F.lit("chars"))))).alias("kind"))
    read_wrong = words.join(wrong, "word", "left_semi").select("seq", F.lit("chars").alias("kind"))
    notes = sure.unionByName(read_wrong).distinct()
    notes = notes.select(F.lit("part2_scientific").alias("src_table"), "seq", F.lit("notes").alias("field_name"), "kind")
    return entries.unionByName(notes).select("src_table", F.col("seq").cast("long").alias("seq"), "field_name", "kind")


# What a digit or mark of Part I can stand for, the usual letter first. Every other mark may be any letter.
LOOKALIKES = (("0", "oó"), ("1", "lií"), ("3", "eé"), ("4", "aá"), ("5", "s"), ("6", "gb"), ("7", "t"), ("8", "b"), ("9", "g"), ("µ", "uú"), ("ſ", "s"), ("†", "t"), ("@", "a"), ("$", "s"))
VOWELS = "aeiouáéíóúàèìòùâêîôûäëïöü"
# Letters in a row by which a damaged word is looked up at most.
RUN = 4


def _split_words(text: Column) -> Column:
    """Words between blanks and hyphens, without outer punctuation."""
    t = F.regexp_replace(text, OMISSION, " ")
    return F.filter(F.transform(F.split(t, r"[\s\-—]+"), lambda w: F.regexp_replace(w, r"^[.,;:'‘’\"`?(]+|[.,;:'‘’\"`?)]+$", "")), lambda w: w != "")


def _damaged(word: Column, head: bool) -> Column:
    """Words of a headword with anything but capitals; of the rest of the entry those with a mark or digit."""
    if head:
        return word.rlike(r"[^\p{Lu}]") & word.rlike(r"\p{L}")
    return word.rlike(MARKED) & ~word.rlike(r"^\d+(?:st|nd|rd|th)$")


def _letters(word: Column) -> Column:
    """Lower-case word; points, commas and quotes put in are gone."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), r"[.,;:'‘’\"`]", ""), r"\(\)", "0")


def _shape(word: Column) -> Column:
    """The letters and look-alikes of a word; a mark that may be any letter is `_`."""
    known = "".join(a for a, _ in LOOKALIKES)
    return F.regexp_replace(_letters(word), rf"[^\p{{L}}{known}]|[\x{{fb00}}-\x{{fb06}}\x{{370}}-\x{{4ff}}]", "_")


def _runs(word: Column, n: int, clean: Column) -> Column:
    """Keys of all runs of n letters: the word's length, the place and the letters."""
    size = F.length(word)
    at = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(":", size, i, clean.substr(i, F.lit(n))))


def _plain_reading(letters: Column) -> Column:
    """Every look-alike as its usual letter; `1` is i between consonants, else l. Marks of no certain letter stay."""
    beside = rf"[{VOWELS}\p{{S}}\p{{P}}]"
    w = F.regexp_replace(letters, rf"(?<!{beside})1(?!{beside})", "i")
    for a, b in LOOKALIKES:
        w = F.replace(w, F.lit(a), F.lit(b[0]))
    return w


def read_words(asked: DataFrame, words: DataFrame) -> DataFrame:
    """asked(seq, head, word, own) and words(head, v, n) -> (seq, head, word, meant), lower-case.

    ``words`` are the undamaged words of the whole corpus, headwords and other words apart; ``own`` those of the same field.
    A word of the same field that fits is taken first, then the only one of the corpus that fits, or for a word of look-alikes the most
    frequent; else each look-alike is read as its usual letter. A mark that may be any letter is
    not guessed and stays.
    """
    a = asked.withColumn("shape", _shape(F.col("word")))
    fits = F.regexp_replace("shape", "_", r"\\p{L}")
    for x, ys in LOOKALIKES:
        fits = F.replace(fits, F.lit(x), F.lit(f"[{ys}]"))
    a = a.withColumn("fits", F.concat(F.lit("^"), fits, F.lit("$"))).withColumn("near", F.get(F.filter("own", lambda w: F.rlike(w, F.col("fits"))), F.lit(0)))
    a = cut(a.drop("own"))
    unread = r"[^\p{L}]|[µſ]"
    clean = F.regexp_replace("shape", unread, "_")
    at = [F.filter(_runs(F.col("shape"), n, clean), lambda k: ~F.contains(k, F.lit("_"))) for n in range(RUN, 1, -1)]
    once = a.where(F.col("near").isNull() & F.col("shape").rlike(unread)).select("head", "shape", "fits").distinct()
    once = once.withColumn("k", F.coalesce(*[F.get(x, F.lit(0)) for x in at])).where(F.col("k").isNotNull())
    shapes = once.select("head", F.length("shape").alias("_n")).distinct()
    keyed = words.withColumn("_n", F.length("v")).join(F.broadcast(shapes), ["head", "_n"], "left_semi")
    keyed = keyed.select("head", "v", "n", F.explode(F.concat(*[_runs(F.col("v"), n, F.col("v")) for n in range(RUN, 1, -1)])).alias("k"))
    hits = once.join(keyed, ["head", "k"]).where(F.rlike("v", F.col("fits")))
    best = hits.groupBy("head", "shape").agg(F.count("*").alias("n_fit"), F.max_by("v", F.struct("n", "v")).alias("best"))
    out = a.join(best, ["head", "shape"], "left")
    guess = _plain_reading(_letters(F.col("word")))
    holes = F.contains("shape", F.lit("_"))
    meant = F.coalesce("near", F.when((F.col("n_fit") == 1) | ~holes, F.col("best")), guess)
    return out.select("seq", "head", "word", meant.alias("meant"))


def _apply(text: Column, pairs: Column) -> Column:
    """Each damaged word of the text (word, meant) replaced, the longest first."""
    longest = F.array_sort(F.coalesce(pairs, F.array().cast("array<struct<word:string,meant:string>>")), lambda a, b: F.length(b["word"]) - F.length(a["word"]))
    return F.aggregate(longest, text, lambda t, p: F.replace(t, p["word"], p["meant"]))


def repaired_entries(p1: DataFrame) -> DataFrame:
    """(seq, raw, headword) of Part I: broken words joined, damaged words of both fields read where they can be.

    The headword printed in front of raw is read as the headword itself; the words after it (dialects, plants,
    authorities) by the words of all entries.
    """
    squash = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    p = flattened(p1).select("seq", "has_head", "rest", "body", squash(healed(F.col("headword"))).alias("hw"), squash(healed(F.col("own"))).alias("printed"))
    small = cut(misread_small_words(p).groupBy("seq").agg(F.collect_list(F.struct("word", "meant")).alias("_small")))
    hurt = F.col("hw").rlike(r"[^\p{Lu}\s\-]"), F.col("rest").rlike(MARKED)
    p = cut(p.drop("body").withColumn("hurt", F.coalesce(hurt[0], F.lit(False)) | F.coalesce(hurt[1], F.lit(False))))
    # few entries have misread small words; only these take part in the join
    few = p.join(small, "seq").withColumn("rest", _apply(F.col("rest"), F.col("_small"))).drop("_small")
    p = p.join(small.select("seq"), "seq", "left_anti").unionByName(few)

    def both(of: DataFrame, words: Callable[[str], Column]) -> DataFrame:
        each = F.explode(F.array(F.struct(F.lit(True).alias("head"), words("hw").alias("ws")), F.struct(F.lit(False).alias("head"), words("rest").alias("ws"))))
        return of.select("seq", each.alias("e")).select("seq", "e.*")

    # few entries are damaged; only their words are looked at one by one
    t = both(p.where("hurt"), lambda c: _split_words(F.col(c)))
    bad = F.when(F.col("head"), F.filter("ws", lambda w: _damaged(w, True))).otherwise(F.filter("ws", lambda w: _damaged(w, False)))
    t = cut(t.withColumn("bad", bad))
    whole = t.select("head", F.explode("ws").alias("w")).where(F.when(F.col("head"), F.col("w").rlike(r"^\p{Lu}+$")).otherwise(F.col("w").rlike(r"^\p{L}+$") & ~F.col("w").rlike(MARK)))
    sound = both(p.where("not hurt"), lambda c: F.split(F.lower(c), r"[^\p{L}]+")).select("head", F.explode("ws").alias("v"))
    words = whole.select("head", F.lower("w").alias("v")).unionByName(sound).where(F.length("v") > 1).groupBy("head", "v").agg(F.count("*").alias("n"))
    own = F.transform(F.filter("ws", lambda w: F.col("head") & w.rlike(r"^\p{Lu}+$")), F.lower)
    asked = t.where(F.size("bad") > 0).select("seq", "head", own.alias("own"), F.explode(F.array_distinct("bad")).alias("word"))
    got = read_words(asked, words)
    first = F.col("word").rlike(r"^[^\p{L}]*\p{Lu}") | ((F.length("word") > 1) & F.col("word").rlike(r"^[^\p{L}]\p{Lu}"))
    shown = F.when(F.col("head"), F.upper("meant")).when(first, F.concat(F.upper(F.substring("meant", 1, 1)), F.expr("substring(meant, 2)"))).otherwise(F.col("meant"))
    pair = F.struct("word", shown.alias("meant"))
    fixes = got.groupBy("seq").agg(F.collect_list(F.when(F.col("head"), pair)).alias("of_head"), F.collect_list(F.when(~F.col("head"), pair)).alias("of_rest"))
    mended = p.where("hurt").join(fixes, "seq", "left").withColumn("hw", _apply(F.col("hw"), F.col("of_head"))).withColumn("rest", _apply(F.col("rest"), F.col("of_rest")))
    p = p.where("not hurt").unionByName(mended.select(p.columns))
    return p.select("seq", F.when(F.col("has_head"), F.concat(F.coalesce("hw", "printed"), "rest")).otherwise(F.col("rest")).alias("raw"), F.col("hw").alias("headword"))


def repaired(part1: DataFrame, part2: DataFrame) -> DataFrame:
    """(src_table, seq, field_name, text): continuous text without furniture, broken words joined, misread words of notes and damaged words of entries corrected."""
    p1, p2 = inspected(part1, part2)
    p2, _, _ = rejoined_notes(p2)
    flat = F.trim(F.regexp_replace("whole", r"\s+", " "))
    of_entry = F.array(F.struct(F.lit("raw").alias("field_name"), F.col("raw").alias("text")), F.struct(F.lit("headword").alias("field_name"), F.col("headword").alias("text")))
    entries = repaired_entries(p1).select(F.lit("part1_vernacular").alias("src_table"), "seq", F.explode(of_entry).alias("e")).select("src_table", "seq", "e.*")
    words = note_words(p2)
    wrong = misread_words(words.groupBy("word").agg(F.count("*").alias("n")))
    fixes = cut(words.join(cut(wrong), "word").groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("word", "meant"))).alias("_fix")))
    core = r"^([(\"']*)(.*?)([.,;:?)\"']*)$"

    def mended(tok: Column) -> Column:
        printed = F.regexp_extract(tok, core, 2)
        meant = F.element_at("_fix", F.lower(printed))
        cased = F.when(F.substring(printed, 1, 1) != F.lower(F.substring(printed, 1, 1)), F.initcap(meant)).otherwise(meant)
        return F.when(meant.isNotNull(), F.concat(F.regexp_extract(tok, core, 1), cased, F.regexp_extract(tok, core, 3))).otherwise(tok)

    # notes without a misread word, by far the most, are only rejoined
    whole = p2.select("seq", flat.alias("text")).join(fixes, "seq", "left")
    text = F.when(F.col("_fix").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.split("text", " "), mended), " "))
    notes = whole.select(F.lit("part2_scientific").alias("src_table"), "seq", F.lit("notes").alias("field_name"), text.alias("text"))
    return entries.unionByName(notes).where(F.col("text").isNotNull())


def p1_found(spark, sf_dir: str) -> DataFrame:
    return damage(read(spark, sf_dir, "part1_vernacular"), read(spark, sf_dir, "part2_scientific"))


def p1_repaired(spark, sf_dir: str) -> DataFrame:
    return repaired(read(spark, sf_dir, "part1_vernacular"), read(spark, sf_dir, "part2_scientific"))
