"""Removal of metadata from story texts: parts as column expressions, and the composed cleaners as plans.

Every cleaner takes a table with ``text`` (and ``title`` where it says so) and returns it with ``narrative`` and ``flag`` ('' where confident); other columns stay. Null texts and titles count as empty.
Patterns run in Java with Unicode classes. Steps are separate projections, so that an intermediate text is computed once, however often it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T

U = "(?U)"


def remove(text: Column, pattern: str, new: str = " ") -> Column:
    return F.regexp_replace(text, U + pattern, new)


def _in(word: Column, words: list[str]) -> Column:
    return word.isin(*words)


def strip_title(text: Column, title: Column) -> Column:
    """A collapsed text without the title that it opens with, whatever its case."""
    text, title = T.collapse(text), T.collapse(title)
    n = F.length(title)
    after, last = text.substr(n + 1, F.lit(1)), title.substr(n, F.lit(1))
    word = U + r"\w"
    edge = F.when(last.rlike(word), ~after.rlike(word)).otherwise(after.rlike(word))
    opens = (n > 0) & F.startswith(F.lower(text), F.lower(title)) & edge
    return F.when(F.coalesce(opens, F.lit(False)), F.ltrim(text.substr(n + 1, F.length(text)))).otherwise(text)


def drop_canvas(text: Column) -> Column:
    """Licence sentences that name CANVAS; the pattern is only tried where the name occurs, as it is quadratic on texts without full stops."""
    return F.when(F.lower(text).contains("canvas"), remove(text, L.CANVAS)).otherwise(text)


def drop_credits(text: Column) -> Column:
    return remove(text, L.CREDIT_JAVA)


def drop_labels(text: Column) -> Column:
    return remove(text, L.META_LABEL)


def drop_genre(text: Column) -> Column:
    return remove(remove(text, L.GENRE_TAG), L.GENRE_PHRASE)


def drop_editorial(text: Column) -> Column:
    return F.when(F.lower(text).contains("pagtambag"), remove(text, L.EDITORIAL)).otherwise(text)


def before(text: Column, pattern: str) -> Column:
    """``text`` up to the first hit of ``pattern``, all of it if there is none. No positions are used: Spark counts them in UTF-16 units and takes them as code points, which differ after an emoji."""
    return F.regexp_replace(text, f"{U}(?:{pattern})(?s:.*)", "")


def since(text: Column, pattern: str) -> Column:
    """``text`` from the first hit of ``pattern`` on, '' if there is none."""
    return F.regexp_extract(text, f"{U}(?:{pattern})(?s:.*)", 0)


def cut_at(text: Column, pattern: str) -> Column:
    """``text`` up to the first hit of ``pattern``."""
    return before(text, pattern)


def cut_at_earliest(text: Column, patterns: tuple[str, ...], least: int) -> Column:
    """``text`` up to the earliest of the first hits of the patterns that stand at ``least`` (from 1) or later."""
    ends = [F.when(text.rlike(U + p), F.length(before(text, p))) for p in patterns]
    first = F.least(*[F.when(e >= least - 1, e) for e in ends])
    return F.when(first.isNotNull(), text.substr(F.lit(1), first)).otherwise(text)


def narrative_index(tokens: Column) -> Column:
    """The place (from 0) of the token where prose begins, null if none: capitalised, and followed by a lower-case word that isn't an English
    stop word, directly or, for a native opener, one further."""
    cores = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    lower = F.transform(cores, lambda c: c.rlike(r"^\p{Ll}") & ~_in(F.lower(c), L.ENG_STOP))
    at = lambda array, k: F.coalesce(F.get(array, k), F.lit(False))
    begins = F.transform(
        cores,
        lambda c, i: (c != "") & ~c.rlike(r"^\p{Ll}") & (at(lower, i + 1) | (_in(F.lower(c), L.OPENERS) & at(lower, i + 2))),
    )
    return F.nullif(F.array_position(begins, True), F.lit(0)) - 1


def with_start(df: DataFrame, text: str) -> DataFrame:
    """``df`` with body, skipped and started for a collapsed column ``text``."""
    out = df.withColumn("_tokens", F.split(F.col(text), " ")).withColumn("_at", narrative_index(F.col("_tokens")))
    rest = F.array_join(F.slice(F.col("_tokens"), F.col("_at").cast("int") + 1, F.greatest(F.size("_tokens"), F.lit(1))), " ")
    before = F.array_join(F.slice(F.col("_tokens"), F.lit(1), F.col("_at").cast("int")), " ")
    return out.withColumns(
        {"body": F.when(F.col("_at").isNotNull(), rest).otherwise(F.col(text)), "skipped": F.when(F.col("_at") > 0, before).otherwise(""), "started": F.col("_at").isNotNull()}
    ).drop("_tokens", "_at")


def prefix_flag() -> Column:
    """no_opener, residual_prefix or '' from what ``with_start`` found."""
    return F.when(~F.col("started"), "no_opener").when((F.col("skipped") == "") | F.col("skipped").rlike(U + L.META_WORD), "").otherwise("residual_prefix")


def walk_publishers(body: Column, flag: Column) -> Column:
    """(body, flag) after at most ten publisher marks: a mark with three or fewer native words after it ends the text; any other is taken out up to the next native word."""
    mark = f"(?i:{L.PUBLISHER})"
    words = r"(?<!\p{L})(?i:" + "|".join(L.NATIVE_FUNC) + r")(?!\p{L})"

    def step(state: Column, _: Column) -> Column:
        text = state["body"]
        head = before(text, mark)
        after = F.regexp_replace(since(text, mark), f"^{U}{mark}", "")
        tail = F.regexp_count(after, F.lit(words)) <= 3
        resumed = F.trim(F.concat(head, F.lit(" "), since(after, words)))
        cut = F.struct(head.alias("body"), state["flag"].alias("flag"), F.lit(True).alias("done"))
        on = F.struct(resumed.alias("body"), F.when(state["flag"] == "", "pub_marker_in_body").otherwise(state["flag"]).alias("flag"), F.lit(False).alias("done"))
        stop = F.struct(text.alias("body"), state["flag"].alias("flag"), F.lit(True).alias("done"))
        return F.when(state["done"] | ~text.rlike(U + mark), stop).when(tail, cut).otherwise(on)

    start = F.struct(body.alias("body"), flag.alias("flag"), F.lit(False).alias("done"))
    return F.when(body.rlike(U + mark), F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, step)).otherwise(start)


def bio_tail(body: Column) -> Column:
    """``body`` without an author's biography at its end, cut where the marker's sentence begins."""
    head = before(body, L.BIO_TAIL)
    ended = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(has_bio_tail(body), T.strip(F.when(ended != "", ended).otherwise(head))).otherwise(body)


def has_bio_tail(body: Column) -> Column:
    return body.rlike(U + L.BIO_TAIL)


def title_repeat(body: Column) -> Column:
    """The rest of ``body`` after a repeated title-case heading, null if it doesn't open with one."""
    title, rest = F.regexp_extract(body, U + L.TITLE_REPEAT, 1), F.regexp_extract(body, U + L.TITLE_REPEAT, 2)
    return F.when((rest != "") & (F.regexp_count(title, F.lit(r"\p{Lu}\p{Ll}")) >= 2) & (T.word_count(rest) >= 3), rest)


def english_caption(body: Column) -> Column:
    """The rest of ``body`` after a first sentence that is mostly English, null if there is none."""
    pattern = U + r"(?s)^\s*(.*?[.!?])(\s+)(\p{Lu}.*)$"
    first, rest = F.regexp_extract(body, pattern, 1), F.regexp_extract(body, pattern, 3)
    tokens = T.bare_tokens(first)
    return F.when((rest != "") & (F.size(tokens) >= 4) & (T.share_of(tokens, L.ENG_ONLY) >= 0.6) & (T.word_count(rest) >= 3), rest)


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))


def _done(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c not in ("narrative", "flag")], "narrative", "flag")


def clean_lines(df: DataFrame) -> DataFrame:
    """The cleaner of line corpora (title, text)."""
    columns = df.columns
    out = _text(df).withColumn("_t", T.basic_clean(F.col("_t")))
    out = out.withColumn("_t", strip_title(F.col("_t"), F.coalesce(F.col("title"), F.lit(""))))
    out = out.withColumn("_t", drop_editorial(drop_canvas(F.col("_t"))))
    out = out.withColumn("_t", T.collapse(drop_genre(drop_labels(drop_credits(F.col("_t"))))))
    out = with_start(out, "_t").withColumn("_f", prefix_flag())
    out = out.withColumn("_b", cut_at(F.col("body"), r"\bKATAPUSAN\b")).withColumn("_s", walk_publishers(F.col("_b"), F.col("_f")))
    out = out.withColumns({"_b": F.col("_s.body"), "_f": F.when(has_bio_tail(F.col("_s.body")), "bio_tail").otherwise(F.col("_s.flag"))}).withColumn("_b", bio_tail(F.col("_b")))
    for find, name in ((title_repeat, "title_repeat"), (english_caption, "english_caption")):
        out = out.withColumn("_r", find(F.col("_b")))
        out = out.withColumns({"_b": F.coalesce("_r", "_b"), "_f": F.when(F.col("_r").isNotNull(), name).otherwise(F.col("_f"))})
    return _done(out.withColumns({"narrative": T.to_field(F.col("_b")), "flag": F.col("_f")}), columns)


def is_name_block(block: Column) -> Column:
    """A block of at most 60 characters, two words or more, all capitalised and none a function word."""
    s = T.collapse(block)
    function = rf"{U}(?i)\b(?:{'|'.join(L.PHIL_FUNC)})\b"
    return (F.length(s) <= 60) & s.rlike(L.NAME_BLOCK) & ~s.rlike(function) & (T.word_count(s) >= 2)


def body_blocks(text: Column) -> Column:
    """The blocks between blank lines from the first that is neither the title (the first block), a name nor an attribution."""
    blocks = F.filter(F.split(text, rf"\n{L.WS}*\n"), lambda b: T.strip(b) != "")
    skipped = F.transform(blocks, lambda b, i: (i == 0) | is_name_block(b) | T.collapse(b).rlike(L.LEAD_ATTRIBUTION))
    first = F.array_position(skipped, False).cast("int")
    return F.when(first > 0, F.slice(blocks, first, F.size(blocks))).otherwise(F.array().cast("array<string>"))


def cut_questions(body: Column) -> Column:
    """``body`` without a numbered run that holds two question marks or more, and its heading."""
    run = F.regexp_extract(body, U + L.NUMBERED, 0)
    return F.when((run != "") & (F.regexp_count(run, F.lit(r"\?")) >= 2), F.regexp_replace(before(body, L.NUMBERED), U + L.QA_HEAD, "")).otherwise(body)


def clean_pages(df: DataFrame) -> DataFrame:
    """The cleaner of page texts with blank-line blocks (text)."""
    columns = df.columns
    out = _text(df).withColumn("_t", drop_canvas(F.regexp_replace(T.basic_clean(F.col("_t")), "\r\n?", "\n")))
    out = out.withColumn("_blocks", body_blocks(F.col("_t"))).withColumn("_any", F.size("_blocks") > 0)
    out = out.withColumn("_b", cut_at(F.array_join("_blocks", "\n"), L.BASAHA_TAIL)).withColumn("_b", cut_questions(F.col("_b")))
    out = out.withColumn("_b", T.to_field(T.strip_page_markers(F.replace(F.col("_b"), F.lit("\n"), F.lit(" ")))))
    out = out.withColumns({"_bio": has_bio_tail(F.col("_b")), "_b": T.to_field(bio_tail(F.col("_b")))})
    for find, name in ((title_repeat, "_title"), (english_caption, "_english")):
        out = out.withColumn("_r", find(F.col("_b"))).withColumns({name: F.col("_r").isNotNull(), "_b": T.to_field(F.coalesce("_r", "_b"))})
    listed = (F.regexp_extract(F.col("_b"), U + L.NUMBERED, 0) != "") & (F.regexp_count(F.regexp_extract(F.col("_b"), U + L.NUMBERED, 0), F.lit(r"\?")) < 2)
    flag = (
        F.when(F.col("_b") == "", "empty").when(F.col("_b").rlike(L.DIGIT_INTERLEAVE), "digit_interleave").when(listed, "numbered_list").when(F.col("_english"), "english_caption")
        .when(F.col("_title"), "title_repeat").when(F.col("_bio"), "bio_tail").otherwise("")
    )
    return _done(out.withColumns({"narrative": F.col("_b"), "flag": flag}), columns)


_ENDS = "[.,!?\"'()\\[\\]:;·—–]"


def tagalog_tokens(sentence: Column) -> Column:
    tokens = F.transform(T.split_words(sentence), lambda w: F.lower(F.regexp_replace(w, f"^{_ENDS}+|{_ENDS}+$", "")))
    return F.filter(tokens, lambda w: w.rlike(r"\p{L}"))


def drop_english(text: Column) -> Column:
    """Sentences without a Tagalog function word (of five tokens or more), or mostly English (of three or more), are left out."""

    def keep(s: Column) -> Column:
        tokens = tagalog_tokens(s)
        native = F.size(F.filter(tokens, lambda w: _in(w, L.TL_FUNC)))
        return ~((F.size(tokens) >= 5) & (native == 0)) & ~((F.size(tokens) >= 3) & (T.share_of(tokens, L.TL_ENGLISH) >= 0.55))

    return F.array_join(F.filter(F.split(text, rf"(?<=[.!?]){L.WS}+"), keep), " ")


def native_density(text: Column) -> Column:
    return T.share_of(T.letter_tokens(text), L.TL_FUNC)


def clean_tagalog(df: DataFrame) -> DataFrame:
    """The cleaner of Tagalog records (text)."""
    columns = df.columns
    out = _text(df).withColumn("_two", F.col("_t").rlike(U + L.BIKOL_SIGNAL)).withColumn("_t", remove(T.basic_clean(F.col("_t")), L.TL_CONTAINER_JAVA, ""))
    out = out.withColumn("_t", drop_english(drop_canvas(F.col("_t"))))
    out = out.withColumn("_t", remove(remove(F.col("_t"), L.TL_BOILERPLATE), L.TL_LABEL)).withColumn("_t", T.collapse(remove(remove(F.col("_t"), L.TL_CREDIT_JAVA), L.TL_STRUCTURE)))
    lead = F.col("_t").rlike(U + L.TL_INSTITUTION) & (F.length(before(F.col("_t"), L.TL_INSTITUTION)) < 60)
    out = out.withColumn("_lead", lead).withColumn("_t", F.when(F.col("_lead"), since(F.col("_t"), L.TL_INSTITUTION)).otherwise(F.col("_t")))
    out = with_start(out, "_t").withColumn("_t", F.when(F.col("_lead"), F.col("body")).otherwise(F.col("_t"))).drop("body", "skipped", "started")
    out = out.withColumn("_b", T.strip_page_numbers(cut_at_earliest(F.col("_t"), (L.TL_QUESTIONS, L.TL_PUBLISHER, L.TL_INSTITUTION), 41)))
    out = with_start(out, "_b").withColumn("_f", prefix_flag()).withColumn("_b", cut_at(bio_tail(F.col("body")), L.TL_PUBLISHER)).withColumn("narrative", T.to_field(F.col("_b")))
    sparse = (F.size(T.letter_tokens(F.col("narrative"))) >= 5) & (native_density(F.col("narrative")) < 0.08)
    return _done(out.withColumn("flag", F.when(sparse, "residual_boilerplate").when(F.col("_two"), "bilingual").otherwise(F.col("_f"))), columns)


_LEVEL_ENDS = "[.,!?\"'()\\[\\]:;·—–“”’]"


def level_tokens(sentence: Column) -> Column:
    tokens = F.transform(T.split_words(sentence), lambda w: F.regexp_replace(w, f"^{_LEVEL_ENDS}+|{_LEVEL_ENDS}+$", ""))
    return F.filter(tokens, lambda w: w.rlike(r"\p{L}"))


def _caps(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda w: (F.length(w) >= 2) & w.rlike(r"\p{Lu}") & (F.upper(w) == w)))


def _native(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda w: _in(F.lower(w), L.LEVEL_NATIVE)))


def _english(tokens: Column) -> Column:
    return T.share_of(F.transform(tokens, lambda w: F.lower(w)), L.TL_ENGLISH)


def is_meta(sentence: Column) -> Column:
    """Whether a sentence is front matter."""
    tokens = level_tokens(sentence)
    n, native = F.size(tokens), _native(tokens)
    ascii_words = F.size(F.filter(tokens, lambda w: w.rlike("^[A-Za-z]+$")))
    return (
        (n == 0) | sentence.rlike(U + L.LEVEL_META) | ((n >= 3) & (_english(tokens) >= 0.5)) | ((_caps(tokens) >= 2) & (native == 0)) | ((n >= 4) & (native == 0) & (ascii_words >= 0.7 * n))
    )


def narrative_score(sentence: Column) -> Column:
    """The native function words of a sentence that can be story, else -1."""
    tokens = level_tokens(sentence)
    n = F.size(tokens)
    out = is_meta(sentence) | T.strip(sentence).rlike(r"\?$") | (n < 4) | (_english(tokens) >= 0.25) | (_caps(tokens) > F.greatest(F.lit(2), F.floor(n / 4)))
    return F.when(out, -1).otherwise(_native(tokens))


_NAME_ENDS = "[.,!?\"'’()\\[\\]:;\\-–—]"


def _is_name(token: Column, all_caps: bool) -> Column:
    w = F.regexp_replace(token, f"^{_NAME_ENDS}+|{_NAME_ENDS}+$", "")
    name = w.rlike(r"^\p{Lu}") & ~_in(F.lower(w), L.LEVEL_NATIVE)
    return name if all_caps else name & ~(w.rlike(r"\p{Lu}") & (F.upper(w) == w))


def strip_name_runs(text: Column) -> Column:
    """``text`` without runs of four or more title-case tokens that are no native words; a token that ends a sentence ends its run."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), empty.alias("run"))

    def flush(s: Column) -> Column:
        return F.when(F.size(s["run"]) < 4, F.concat(s["out"], s["run"])).otherwise(s["out"])

    def step(s: Column, t: Column) -> Column:
        longer = F.array_append(s["run"], t)
        closed = F.struct(F.when(F.size(longer) < 4, F.concat(s["out"], longer)).otherwise(s["out"]).alias("out"), empty.alias("run"))
        going = F.struct(s["out"].alias("out"), longer.alias("run"))
        plain = F.struct(F.array_append(flush(s), t).alias("out"), empty.alias("run"))
        return F.when(_is_name(t, False), F.when(t.rlike("[.!?]$"), closed).otherwise(going)).otherwise(plain)

    return F.array_join(F.aggregate(T.split_words(text), start, step, flush), " ")


def strip_leading_names(text: Column) -> Column:
    """``text`` without two to fourteen leading names, or a leading stub of one or two letters."""
    tokens = T.split_words(text)
    names = F.transform(F.slice(tokens, 1, 14), lambda t: _is_name(t, True))
    stop = F.array_position(names, False).cast("int")
    n = F.when(stop > 0, stop - 1).otherwise(F.size(names))
    stub = F.regexp_replace(F.get(tokens, F.lit(0)), "^[\".,!?]+|[\".,!?]+$", "")
    short = "si sa ng ay na at ni o ba pa po ho ka ko mo a".split()
    is_stub = (F.size(tokens) > 1) & (F.length(stub) <= 2) & ~_in(F.lower(stub), short) & F.get(tokens, F.lit(1)).rlike(r"^\p{Lu}")
    drop = F.when(n >= 2, n).when(F.coalesce(is_stub, F.lit(False)), 1).otherwise(0)
    return F.when(drop > 0, F.array_join(F.slice(tokens, drop + 1, F.greatest(F.size(tokens), F.lit(1))), " ")).otherwise(text)


def strip_container(text: Column, level: Column) -> Column:
    """``text`` without a leading ``name, level,`` of its own level."""
    start = rf"^.{{1,100}}?,{L.WS}*([0-9]+){L.WS}*,{L.WS}*"
    return F.when(F.regexp_extract(text, start, 1) == level.cast("string"), F.regexp_replace(text, start, "")).otherwise(text)


def cut_trailing_junk(text: Column) -> Column:
    """``text`` up to its last sentence that is no question and has three words or more; '' if it has none."""
    sentences = F.split(text, rf"(?<=[.!?]){L.WS}+")
    good = F.transform(sentences, lambda s: ~(T.strip(s).rlike(r"\?$") | (F.size(F.filter(T.split_words(s), lambda w: w.rlike(r"\p{L}"))) < 3)))
    last = F.size(good) - F.array_position(F.reverse(good), True).cast("int") + 1
    return F.when(F.array_contains(good, True), F.array_join(F.slice(sentences, F.lit(1), F.greatest(last, F.lit(1))), " ")).otherwise("")


def clean_levels(df: DataFrame) -> DataFrame:
    """The cleaner of per-level Tagalog records (level, text); a record without a story becomes empty."""
    columns = df.columns
    sentences = lambda c: F.split(F.col(c), rf"(?<=[.!?]){L.WS}+")
    out = _text(df).withColumn("_t", strip_container(F.col("_t"), F.col("level")))
    out = out.withColumn("_t", drop_canvas(T.basic_clean(F.col("_t"))))
    out = out.withColumn("_t", remove(F.regexp_replace(F.regexp_replace(F.col("_t"), L.JUNK_GLYPHS, " "), "_{2,}", " "), L.PRODUCT_CODE))
    for _ in range(4):
        out = out.withColumn("_t", remove(F.col("_t"), L.LEVEL_CREDIT))
    out = out.withColumn("_t", remove(remove(F.col("_t"), L.LEVEL_CREDIT_NOUN), L.LEVEL_ORPHAN)).withColumn("_t", strip_name_runs(F.col("_t")))
    out = out.withColumn("_t", remove(remove(remove(F.col("_t"), L.CAPS_RUN), L.EMPTY_QUOTES), L.PAGE_BANNER))
    out = out.withColumn("_t", F.regexp_replace(F.col("_t"), rf"(?<!{L.NOT_WS})\d{{1,3}}(?!{L.NOT_WS})", " "))
    out = out.withColumn("_s", F.filter(sentences("_t"), lambda s: ~is_meta(s))).withColumn("_n", F.transform(F.col("_s"), narrative_score))
    first = F.array_position(F.transform(F.col("_n"), lambda n: n >= 2), True).cast("int")
    gate = (first > 0) & (F.exists("_n", lambda n: n >= 3) | (F.size(F.filter("_n", lambda n: n >= 2)) >= 2))
    story = F.array_join(F.slice(F.col("_s"), F.greatest(first, F.lit(1)), F.greatest(F.size("_s"), F.lit(1))), " ")
    out = out.withColumn("_b", F.when(gate, T.collapse(story)).otherwise(""))
    out = out.withColumn("_b", cut_at_earliest(F.col("_b"), (L.LEVEL_TAIL, L.LEVEL_PUBLISHER), 41)).withColumn("_b", T.strip(strip_leading_names(F.col("_b"))))
    kept = cut_trailing_junk(F.col("_b"))
    return _done(out.withColumn("narrative", T.collapse(kept)).withColumn("flag", F.when(F.col("narrative") == "", "empty").otherwise("")), columns)


def long_enough(df: DataFrame, column: str = "narrative", least: int = L.LEVEL_MIN_WORDS) -> DataFrame:
    """The rows of ``df`` whose ``column`` has ``least`` words or more."""
    return df.where(T.word_count(F.coalesce(F.col(column), F.lit(""))) >= least)


def clean_first_generation(df: DataFrame) -> DataFrame:
    """The first-generation cleaners by language (language, title, text), each followed by the first-generation normalization; flag tells texts of page corpora without a tail mark (unmatched)."""
    columns = df.columns
    low = F.lower(F.coalesce("language", F.lit("")))
    out = _text(df).withColumn("_t", T.undo_latin1(F.col("_t")))
    titled = strip_title(F.col("_t"), F.coalesce("title", F.lit("")))
    out = out.withColumns({"_k": F.when(low == "cebuano", "c").when(low == "bikol", "b").otherwise("p"), "_o": F.when(low.isin("cebuano", "bikol"), titled).otherwise(F.col("_t"))})
    ceb = F.regexp_replace(drop_genre(drop_labels(drop_credits(F.col("_o")))), U + r"(?i)\s*\bKATAPUSAN\b\s*$", "")
    bik = cut_at(cut_at(remove(F.col("_o"), L.GEN1_LEAD, ""), L.GEN1_BIKOL_ACTIVITY), L.GEN1_BOILERPLATE)
    lines = F.split(F.col("_o"), "\n")
    title_at = F.array_position(F.transform(lines, lambda x: T.strip(x) != ""), True).cast("int")
    rest = F.slice(lines, F.greatest(title_at, F.lit(0)) + 1, F.size(lines))
    function = rf"{U}(?i)\b(?:{'|'.join(w for w in L.PHIL_FUNC if w not in ('may', 'isa', 'ka'))})\b"
    author = lambda x: (F.length(T.strip(x)) <= 50) & T.strip(x).rlike(r"^(?:\p{Lu}[\p{L}.\-]+\.?\s+)*\p{Lu}[\p{L}.\-]+\.?$") & ~x.rlike(function) & (T.word_count(x) >= 2)
    page = F.array_join(F.filter(rest, lambda x, i: ~((i < 15) & (T.strip(x).rlike(L.GEN1_LEAD_LINE) | author(x)))), "\n")
    out = out.withColumn("_p", page).withColumn("_hit", F.col("_p").rlike(U + L.GEN1_ACTIVITY) | F.col("_p").rlike(U + L.GEN1_BOILERPLATE))
    pages = T.strip_page_markers(cut_at(cut_at(F.col("_p"), L.GEN1_ACTIVITY), L.GEN1_BOILERPLATE))
    out = out.withColumn("_b", F.when(F.col("_k") == "c", ceb).when(F.col("_k") == "b", bik).otherwise(pages))
    scrubbed = F.regexp_replace(T.strip_urls(T.scrub_entities(F.col("_b"))), r"[ \t]+", " ")
    final = T.normalize_first(T.strip(F.when(F.col("_k") == "p", F.regexp_replace(scrubbed, "\n{3,}", "\n\n")).otherwise(F.regexp_replace(scrubbed, "\n{2,}", "\n"))))
    return _done(out.withColumns({"narrative": final, "flag": F.when((F.col("_k") == "p") & ~F.col("_hit"), "unmatched").otherwise("")}), columns)
