"""Line grammars: entries of one line (native name -> taxa) and blocks under a heading (taxon -> family, notes, native names)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernalex.functions.text import repair_typography

LETTER = "A-Za-zÀ-ÿ"
# A blank within brackets, so that a bracket is one word.
GLUE = "\u0002"
HEAD_MIN, HEAD_MAX = 2, 60
#: words of a line that is a page number or a printer's signature
SIGNATURE = r"^(?:\d{1,3}|[A-Z]\.|[IVXL]{1,7})$"
#: a marker of a dialect as scanned: a few letters or look-alikes and a stop, or two such joined by a hyphen
MARKER_WORD = r"^(?:[\w\[\]|']{1,5}[.:]|[A-Z]\p{Ll}{1,3}\.-[A-Z]\p{Ll}{1,3}[.:]?)\??[,;]?[-~*=+]*$"
BRACKET_WORD = r"^\([^()]*\)[.,;:]*$"
DEBRIS_WORD = r"^[^\p{L}\d?\[(]+$"
#: what a cited plant begins with
TAXON_WORD = r"^(?:\p{Lu}[\p{Ll}?\[]|\p{Lu}\.{2}|\[\p{Ll}|\?$|\.\.|--)"


def words_of_line(line: Column) -> Column:
    """Words between blanks, a bracket being one word, set apart from what it follows."""
    x = F.regexp_replace(F.replace(line, F.lit("("), F.lit(" (")), r"(?<!^) (?=[^()]*\))", GLUE)
    return F.filter(F.split(x, " "), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, whatever the times and the lambdas it is used in."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _slice_from(words: Column, start: Column) -> Column:
    """The words from the 1-based place on."""
    return F.slice(words, F.greatest(start, F.lit(1)), F.greatest(F.size(words), F.lit(1)))


def _first_place(words: Column, test) -> Column:
    """The 1-based place of the first word that passes, 0 if none does."""
    return F.coalesce(F.array_position(F.transform(words, lambda w, i: F.coalesce(test(w, i), F.lit(False))), F.lit(True)), F.lit(0)).cast("int")


def is_signature(words: Column) -> Column:
    """One or two words and nothing but numbers of pages or signatures of the printer."""
    return F.size(words).between(1, 2) & F.forall(words, lambda w: w.rlike(SIGNATURE)) & ((F.size(words) == 1) | F.forall(words, lambda w: w.rlike(r"^\d+$")))


def parse_entry_lines(lines: DataFrame, line: str) -> DataFrame:
    """Add head, locs, place, sci (null if absent) and parsed to each line; signatures and blank lines are left out.

    The line is read word by word: the headword ends with the first word that closes with a comma, semicolon or stop, or stands before a bracket, or is in capitals and stands before a plant; then
    markers, brackets and debris are taken as long as they go on; what is left must begin as a plant's name does. An
    inner stop of the headword is dropped, marks around it too.
    """
    x = F.regexp_replace(repair_typography(line), rf"^[^{LETTER}\d(\[?]+", "")
    df = lines.withColumn("line_read", x)
    df = df.withColumn("_e", F.when(F.col("line_read") != "", let(words_of_line(F.col("line_read")), _entry)))
    df = df.where(F.col("_e").isNotNull())
    given = lambda c: F.when(F.col("_e.parsed") & (F.trim(c) != ""), F.trim(c))
    fields = {c: given(F.col(f"_e.{c}")) for c in ("head", "locs", "place", "sci")}
    return df.withColumns({**fields, "parsed": F.col("_e.parsed")}).drop("_e")


def _entry(w: Column) -> Column:
    """struct(head, locs, place, sci, parsed) of a line's words; null of a signature."""
    closes = lambda v, ahead: v.rlike(r"[^.,;][.,;][-~*]*$") | F.startswith(ahead, F.lit("(")) | ((_capitals_in(v) >= 2) & ahead.rlike(TAXON_WORD))
    closing = _first_place(w, lambda v, i: closes(v, F.coalesce(F.get(w, i + 1), F.lit(""))))
    goes_on = lambda v: v.rlike(MARKER_WORD) | v.rlike(BRACKET_WORD) | v.rlike(DEBRIS_WORD)

    def read(k: Column, after: Column, m: Column) -> Column:
        printed = F.array_join(F.slice(w, F.lit(1), F.greatest(k, F.lit(1))), " ")
        taken = F.when(m > 0, F.slice(after, F.lit(1), F.greatest(m - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
        sci = F.when(m > 0, F.translate(F.regexp_replace(F.array_join(_slice_from(after, m), " "), r"^['‘’]+", ""), GLUE, " "))
        head = F.regexp_replace(F.regexp_replace(printed, rf"(?<=[{LETTER}])\.(?=[{LETTER}])", ""), rf"^[^{LETTER}]+|[^{LETTER}]+$", "")
        marks = F.filter(taken, lambda v: v.rlike(MARKER_WORD))
        joined = F.regexp_replace(F.array_join(F.transform(marks, lambda v: F.regexp_replace(v, r"[-~*=+]+$", "")), " "), r"[,;]+$", "")
        locs = F.when(joined != "", F.concat(F.when(printed.rlike(r";[-~*]*$"), "; ").otherwise(", "), joined))
        bracket = F.get(F.filter(taken, lambda v: v.rlike(BRACKET_WORD)), F.lit(0))
        place = F.regexp_replace(F.translate(bracket, GLUE, " "), r"^\(|\)[.,;:]*$", "")
        ok = (k > 0) & (m > 0) & F.length(printed).between(HEAD_MIN, HEAD_MAX) & (head != "") & sci.rlike(TAXON_WORD)
        return F.struct(head.alias("head"), locs.alias("locs"), place.alias("place"), sci.alias("sci"), F.coalesce(ok, F.lit(False)).alias("parsed"))

    found = let(closing, lambda k: let(_slice_from(w, k + 1), lambda after: let(_first_place(after, lambda v, i: ~goes_on(v)), lambda m: read(k, after, m))))
    return F.when(~is_signature(w), found)


def markers(locs: Column) -> Column:
    """The dialect markers of a marker list, without their punctuation."""
    each = F.filter(F.split(locs, r"[\s,;]+"), lambda m: m != "")
    return F.coalesce(F.transform(each, lambda m: F.regexp_replace(m, r"[.:]\??$", "")), F.array().cast("array<string>"))


def taxon_list(sci: Column) -> Column:
    """Taxa of an entry, split at `--`, closing stops removed, blanks dropped."""
    each = F.transform(F.split(sci, r"\s*--\s*"), lambda s: F.trim(F.regexp_replace(s, r"\s*[.;]\s*$", "")))
    return F.filter(each, lambda s: s != "")


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def page_margins(lines: DataFrame, page: list[str], line: str) -> DataFrame:
    """(page, margin): the smallest indent that recurs on max(2, 10 %) of the long lines, else the smallest."""
    long = lines.where(F.length(F.trim(line)) >= 20).select(*page, indent(F.col(line)).alias("_i"))
    counts = long.groupBy(*page, "_i").agg(F.count("*").alias("_n"))
    total = counts.groupBy(*page).agg(F.sum("_n").alias("_all"), F.min("_i").alias("_least"))
    need = F.greatest(F.lit(2), F.ceil(F.col("_all") * 0.1))
    recurring = counts.join(total, page).groupBy(*page).agg(F.min(F.when(F.col("_n") >= need, F.col("_i"))).alias("_r"), F.first("_least").alias("_least"))
    return recurring.select(*page, F.coalesce("_r", "_least").alias("margin"))


def dedent(line: Column, margin: Column) -> Column:
    """Remove as many characters as the margin, blanks or not."""
    return F.substring(line, margin + 1, F.length(line))


def _letters_in(word: Column) -> Column:
    return F.length(F.regexp_replace(word, rf"[^{LETTER}]", ""))


def _capitals_in(word: Column) -> Column:
    return F.length(F.regexp_replace(word, r"[^\p{Lu}]", ""))


def capital_epithet(word: Column) -> Column:
    """A word of four letters or more, two of them capitals, as epithets are printed (and misread)."""
    return (_letters_in(word) >= 4) & (_capitals_in(word) >= 2)


def restore_initial(line: Column) -> Column:
    """A lost or damaged initial of an abbreviated genus becomes `?. `; a sound one (`A. `) stays.

    It is missed where a word of one or two letters or with marks, closed by a stop, stands before an epithet in capitals, or where
    a line set in by up to four blanks begins with one and goes on with a capital.
    """

    def restored(w: Column) -> Column:
        first, second = F.get(w, F.lit(0)), F.coalesce(F.get(w, F.lit(1)), F.lit(""))
        rest = F.array_join(_slice_from(w, F.lit(2)), " ")
        blanks = F.length(line) - F.length(F.ltrim(line))
        sound = (_capitals_in(first) == 1) & (F.length(first) == 2)
        broken = F.endswith(first, F.lit(".")) & ~sound & ((_letters_in(first) <= 2) | first.rlike(rf"[^{LETTER}.]")) & ~F.startswith(first, F.lit("?"))
        moved = blanks.between(1, 4) & (F.length(first) >= 4) & (_capitals_in(first) == F.length(first)) & second.rlike(r"^\p{Lu}[\p{Ll}.]")
        return F.when(broken & capital_epithet(second), F.concat(F.lit("?. "), rest)).when(moved, F.concat(F.lit("?. "), F.trim(line))).otherwise(line)

    return let(F.split(F.trim(line), r"\s+"), restored)


HEADING_SCORE = 3


def heading_score(line: Column) -> Column:
    """Points for and against a dedented line opening a block: an initial, a name in capitals, a stop before a capital or a bracket; against it
    small letters, a deep indent, the commas and semicolons of native names."""
    point = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    set_in = F.length(line) - F.length(F.ltrim(line))

    def scored(t: Column, w: Column, first: Column, second: Column) -> Column:
        initial = first.rlike(r"^[\p{Lu}?]\.$")
        return (
            point(t.rlike(r"^\p{Lu}"), 1)
            + point(initial, 3)
            + point((_letters_in(first) >= 3) & (_capitals_in(first) >= 2) | capital_epithet(second), 2)
            + point((_letters_in(first) >= 3) & F.endswith(first, F.lit(".")) & second.rlike(r"^[(\p{Lu}]"), 2)
            - point(t.rlike(r"^\p{Ll}") | (set_in >= 5) | is_signature(w), 9)
            - point(F.contains(t, F.lit(";")) & ~initial | (F.endswith(first, F.lit(",")) & second.rlike(MARKER_WORD)), 4)
        )

    words = lambda t, w: let(F.get(w, F.lit(0)), lambda first: let(F.coalesce(F.get(w, F.lit(1)), F.lit("")), lambda second: scored(t, w, first, second)))
    return let(F.trim(restore_initial(line)), lambda t: let(words_of_line(t), lambda w: words(t, w)))


def is_heading(line: Column) -> Column:
    """Whether a dedented line opens a block; a blank line doesn't, a null is null."""
    return F.when(F.trim(line) == "", False).otherwise(heading_score(line) >= HEADING_SCORE)


def block_ids(df: DataFrame, heading: str, order: str, group: list[str], chunk: str, into: str = "block") -> DataFrame:
    """Number of headings at or before each row of its group (0 before the first), by chunk sums and a running sum within the chunk."""
    flag = F.coalesce(F.col(heading).cast("int"), F.lit(0))
    per = df.groupBy(*group, chunk).agg(F.sum(flag).alias("_n"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*group, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(per, [*group, chunk]).withColumn(into, F.col("_before") + F.sum(flag).over(inner)).drop("_before")


def join_block(lines: Column, heal: bool = False) -> Column:
    """One text of a block's lines; ``heal`` joins words broken by a hyphen at a line end."""
    clean = F.filter(F.transform(lines, lambda s: F.trim(F.replace(s, F.lit("\\"), F.lit("")))), lambda s: s != "")
    text = F.array_join(clean, "\n")
    if heal:
        text = F.regexp_replace(text, "([A-Za-z\u00e9])-\n(?=[a-z\u00e9])", "$1")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


# Letters that a piece of a run-together block has at least.
LEAST_PIECE = 14


def split_run_together(blocks: DataFrame, text: str) -> DataFrame:
    """Explode blocks where an inner abbreviated genus stands before an epithet in capitals (columns piece, text).

    Words are laid into pieces one after the other; a new piece begins with such an initial once the last one is long enough. Null texts have no piece.
    """

    def opens(v: Column, ahead: Column) -> Column:
        return v.rlike(r"^[\p{Lu}?]\.$") & (_letters_in(ahead) >= 4) & (_capitals_in(ahead) >= 4)

    def lay(pieces: Column, p: Column) -> Column:
        def on(last: Column) -> Column:
            longer = F.concat(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array(F.when(last == "", p["w"]).otherwise(F.concat(last, F.lit(" "), p["w"]))))
            return F.when(p["o"] & (F.length(last) >= LEAST_PIECE), F.concat(pieces, F.array(p["w"]))).otherwise(longer)

        return let(F.element_at(pieces, -1), on)

    def laid(w: Column) -> Column:
        flagged = F.transform(w, lambda v, i: F.struct(v.alias("w"), opens(v, F.coalesce(F.get(w, i + 1), F.lit(""))).alias("o")))
        return F.aggregate(flagged, F.array(F.lit("")), lay)

    pieces = let(F.split(F.trim(F.col(text)), r"\s+"), laid)
    return blocks.select(*[c for c in blocks.columns if c != text], F.posexplode(pieces).alias("piece", text))


# Words that begin a sentence, not a name.
SENTENCE_WORDS = ("a", "an", "cultivated", "in", "of", "the", "these", "this", "used")
NAME_WORDS = 4


def as_vernacular(segment: Column) -> Column:
    """struct(name, dialects, place) of a segment that reads as a native name, else null.

    A bracket is its place; of what stands between commas the first is the name, of a few words of letters, and all others must be markers.
    """

    def read(s: Column, parts: Column) -> Column:
        place = F.regexp_extract(s, r"\(([^()]*)\)", 1)
        name = F.get(parts, F.lit(0))
        codes = F.filter(_slice_from(parts, F.lit(2)), lambda d: d != "")
        dialects = F.transform(codes, lambda d: F.regexp_replace(d, r"\.$", ""))
        words = F.split(name, " +")
        named = name.rlike(rf"^[{LETTER}' -]+$") & (F.size(words) <= NAME_WORDS) & F.length(name).between(2, 41)
        marked = F.forall(dialects, lambda d: F.concat(d, F.lit(".")).rlike(MARKER_WORD))
        prose = (F.size(codes) == 0) & (place == "") & F.lower(F.get(words, F.lit(0))).isin(*SENTENCE_WORDS)
        return F.when(named & marked & ~prose, F.struct(name.alias("name"), dialects.alias("dialects"), F.when(place != "", place).alias("place")))

    parts = lambda s: F.transform(F.split(F.regexp_replace(s, r"\([^()]*\)", ""), ","), lambda x: F.trim(x))
    return let(F.regexp_replace(F.trim(segment), r"[.,\s]+$", ""), lambda s: let(parts(s), lambda p: read(s, p)))


def split_notes(rest: Column) -> Column:
    """struct(notes, vernaculars): native names between semicolons at the end, also one after the last sentence, and the prose before them.

    Read from the end: segments are names until one isn't; of that one the words after its last stop may be a name too.
    """
    segments = F.reverse(F.filter(F.transform(F.split(rest, ";"), lambda x: F.trim(x)), lambda s: s != ""))
    nothing = F.array().cast("array<struct<name:string,dialects:array<string>,place:string>>")
    start = F.struct(F.lit(True).alias("open"), nothing.alias("names"), F.array().cast("array<string>").alias("prose"))

    def taken(state: Column, s: Column, whole: Column, tail: Column) -> Column:
        after = F.substring_index(s, ". ", -1)
        before = F.when(tail.isNotNull(), F.substring(s, F.lit(1), F.length(s) - F.length(after) - 1)).otherwise(s)
        names = F.when(state["open"] & whole.isNotNull(), F.concat(F.array(whole), state["names"])).when(state["open"] & tail.isNotNull(), F.concat(F.array(tail), state["names"])).otherwise(state["names"])
        prose = F.when(~state["open"], F.concat(F.array(s), state["prose"])).when(whole.isNull(), F.array(before)).otherwise(state["prose"])
        return F.struct((state["open"] & whole.isNotNull()).alias("open"), names.alias("names"), prose.alias("prose"))

    def take(state: Column, s: Column) -> Column:
        tail = F.when(state["open"] & F.contains(s, F.lit(". ")), as_vernacular(F.substring_index(s, ". ", -1)))
        return let(F.when(state["open"], as_vernacular(s)), lambda whole: let(F.when(whole.isNull(), tail), lambda t: taken(state, s, whole, t)))

    notes = lambda read: F.regexp_replace(F.array_join(read["prose"], "; "), r"^[\s.;]+", "")
    return let(F.aggregate(segments, start, take), lambda read: F.struct(F.when(notes(read) != "", notes(read)).alias("notes"), read["names"].alias("vernaculars")))


def family_bracket(text: Column, families: Column | None = None) -> Column:
    """The bracketed word of a text that is a listed family (an array column of names), or, without a list, looks like one; every bracket is tried."""
    inner = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: F.trim(x))
    key = lambda w: F.lower(F.regexp_replace(w, r"[\s.]+", ""))
    if families is not None:
        return let(F.transform(families, key), lambda listed: F.get(F.filter(inner, lambda w: F.array_contains(listed, key(w))), F.lit(0)))
    return F.get(F.filter(inner, lambda w: (F.length(w) >= 4) & ~F.contains(w, F.lit(" ")) & key(w).rlike("(?:[ceo]e|ae|e[wx]|æ)$")), F.lit(0))


def parse_block(text: Column, families: Column | None = None) -> Column:
    """struct(name, authority, family_raw, rest) of a block's text.

    The name is its first two words, a genus alone if that closes with a stop; the authority goes on to the family's bracket, else to the first word of
    two letters or more that closes with a stop; the rest follows.
    """
    stripped = lambda c: F.regexp_replace(c, r"[.,\s]+$", "")

    def cut(family: Column, at: Column, w: Column, n: Column, after: Column, length: Column) -> Column:
        authority = stripped(F.array_join(F.slice(after, F.lit(1), length), " "))
        rest = F.when(at > 0, F.substring(text, at + F.length(family) + 2, F.length(text))).otherwise(F.array_join(_slice_from(after, length + 1), " "))
        return F.struct(
            stripped(F.array_join(F.slice(w, F.lit(1), n), " ")).alias("name"),
            F.when(authority != "", authority).alias("authority"),
            stripped(family).alias("family_raw"),
            F.regexp_replace(F.trim(rest), r"^[.\s]+", "").alias("rest"),
        )

    def read(family: Column, at: Column, w: Column) -> Column:
        alone = F.coalesce(F.endswith(F.get(w, F.lit(0)), F.lit(".")) & (_letters_in(F.get(w, F.lit(0))) >= 3), F.lit(False))
        # an authority is made of capitalised words and what joins them
        stop = lambda after: _first_place(after, lambda v, i: F.endswith(v, F.lit(".")) & (_letters_in(v) >= 2))
        prose = lambda after: _first_place(after, lambda v, i: ~v.rlike(r"^\p{Lu}") & ~v.isin("&", "et", "ex", "in", "f."))
        length = lambda after, k, q: F.when(at > 0, F.size(after)).when(~alone & (k > 0) & ((q == 0) | (q > k)), k).otherwise(0)
        tail = lambda n, after: let(stop(after), lambda k: let(prose(after), lambda q: let(length(after, k, q), lambda z: cut(family, at, w, n, after, z))))
        return let(F.when(alone, 1).otherwise(F.least(F.size(w), F.lit(2))), lambda n: let(_slice_from(w, n + 1), lambda after: tail(n, after)))

    words = lambda at: F.filter(F.split(F.trim(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)), r"\s+"), lambda v: v != "")
    place = lambda family: F.coalesce(F.when(family.isNotNull(), F.instr(text, F.concat(F.lit("("), family))), F.lit(0))
    return let(family_bracket(text, families), lambda family: let(place(family), lambda at: let(words(at), lambda w: read(family, at, w))))


def is_fragment(name: Column, family: Column, notes: Column, vernaculars: Column, corrected: Column) -> Column:
    """A single word without anything else, never corrected: debris, not an entry."""
    empty = F.coalesce(F.size(vernaculars), F.lit(0)) <= 0
    return ~F.contains(name, F.lit(" ")) & family.isNull() & notes.isNull() & empty & ~F.coalesce(corrected, F.lit(False))


def bare_marker(token: Column) -> Column:
    """A marker without blanks and the punctuation around it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"\s+", ""), "^[,;.'‘’]+", ""), "[.:?'‘’]+$", "")


def canonical_marker(token: Column, codes: list[str], misread: dict[str, str] | None = None) -> Column:
    """The dialect code of a marker: punctuation aside, case aside; ``misread`` spellings (case as given) as a last resort, else null."""
    bare = bare_marker(token)
    listed = F.create_map(*[F.lit(x) for c in codes for x in (c.lower(), c)]) if codes else F.lit(None).cast("map<string,string>")
    out = F.element_at(listed, F.lower(bare))
    if misread:
        out = F.coalesce(out, F.element_at(F.create_map(*[F.lit(x) for kv in misread.items() for x in kv]), bare))
    return out


def sections(lines: DataFrame, group: list[str], page: str, line: str, openings: dict[str, str]) -> DataFrame:
    """(group, section, first_page, last_page) of sections opened by a line that fits a pattern.

    A section ends on the page before the next one opens, the last with the
    last page; a section that never opens is missing.
    """
    marks = F.array_compact(F.array(*[F.when(F.col(line).rlike(p), F.lit(name)) for name, p in openings.items()]))
    first = lines.select(*group, page, F.explode(marks).alias("section")).groupBy(*group, "section").agg(F.min(page).alias("first_page"))
    last = lines.groupBy(*group).agg(F.max(page).alias("_end"))
    nxt = F.lead("first_page").over(Window.partitionBy(*group).orderBy("first_page", "section"))
    return first.join(last, group).withColumn("last_page", F.greatest("first_page", F.coalesce(nxt - 1, F.col("_end")))).drop("_end")


def unresolved_family(text: Column) -> Column:
    """A bracketed word that looks like a family though none was resolved, to extend the list by; null if there is none."""
    return F.regexp_replace(family_bracket(text), r"[.\s]+$", "")
