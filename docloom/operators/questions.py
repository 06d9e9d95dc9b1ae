"""Gold binding and question generation (Q01-Q06)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources.shared import settle

c = F.col


def bind_gold(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Q01: question_id, chunk_id (null: abstention expected), bound_by.

    The first live chunk that holds the passage, digits alike; else the first with its first six tokens. A question meets
    the chunks of the rarest of those tokens alone, which are then asked for the others."""
    q = questions.select("question_id", T.to_latin_digits(T.normalize("passage")).alias("passage")).withColumn("need", F.slice(F.array_distinct(T.all_tokens("passage")), 1, 6)).where(F.size("need") > 0)
    k = chunks.select("chunk_id", "document_id", "chunk_index", T.to_latin_digits(T.normalize("text")).alias("text")).withColumn("tokens", F.array_distinct(T.all_tokens("text")))
    wanted = q.select("question_id", F.explode("need").alias("token"))
    posting = settle(k.select("chunk_id", F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi"), "postings")
    df = posting.groupBy("token").agg(F.count("*").alias("df"))
    rarest = wanted.join(df, "token", "left").groupBy("question_id").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), F.col("token"))).alias("token"))
    near = rarest.join(posting, "token").select("question_id", "chunk_id")
    possible = near.join(q, "question_id").join(k, "chunk_id").where(F.size(F.array_except("need", "tokens")) == 0)
    exact = F.contains("text", "passage")
    order = W.partitionBy("question_id").orderBy((~exact).cast("int"), "document_id", "chunk_index", "chunk_id")
    best = possible.withColumns({"r": F.row_number().over(order), "bound_by": F.when(exact, "passage").otherwise("tokens")}).where("r = 1").select("question_id", "chunk_id", "bound_by")
    return questions.select("question_id").join(best, "question_id", "left").withColumn("expect_abstention", c("chunk_id").isNull())


#: Q02, fixed values: the category of a tag.
TAG_CATEGORIES = {"leave": "policy_lookup", "remote": "policy_lookup", "travel": "policy_lookup", "handbook": "factual", "abstain": "factual"}


def category(rows: DataFrame, names: dict[str, str] = TAG_CATEGORIES, default: str = "factual") -> DataFrame:
    """Q02: the category of the first tag that has one; tags are compared as they are."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    found = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull())
    return rows.withColumn("category", F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(default)))


#: Q03, fixed values: categories in the order of their rotation, with difficulty, the words of which one must stand in the sentence
#: (none: always asked) and the question about «topic».
ASKED = [
    ("factual", "easy", [], None),
    ("policy_lookup", "easy", [], None),
    ("numerical", "easy", [], "طبق متن، مقدار عددی مرتبط با «{topic}» چقدر است؟"),
    ("date", "medium", ["روز", "ماه", "سال", "مهلت", "تاریخ", "شنب", "جمعه"], "زمان‌بندی یا مهلت مربوط به «{topic}» در سند چگونه بیان شده است؟"),
    ("definition", "easy", [], "سند «{topic}» را چگونه توصیف می‌کند؟"),
    ("procedure", "medium", [], "مراحل انجام «{topic}» طبق سند چیست؟"),
    ("exception", "hard", ["استثنا", "مگر", "فقط", "حداکثر", "ممنوع", "نباید"], "چه محدودیت یا استثنایی دربارهٔ «{topic}» آمده است؟"),
    ("comparison", "hard", ["نسبت", "در مقایسه", "یا"], "تفاوت یا مقایسهٔ بیان‌شده دربارهٔ «{topic}» چیست؟"),
    ("yes_no", "medium", ["نمی", "نیست", "مجاز", "الزامی"], "آیا طبق سند، «{topic}» مجاز یا الزامی است؟"),
    ("list", "medium", ["،", "و"], "فهرست موارد مرتبط با «{topic}» در سند چیست؟"),
    ("responsibility", "medium", ["مسئول", "مدیر", "منابع انسانی", "کارمند", "واحد"], "مسئولیت مرتبط با «{topic}» بر عهده کیست؟"),
    ("permission", "medium", ["مجاز", "اجازه", "می‌توان", "اختیار"], "چه مجوزهایی برای «{topic}» در سند ذکر شده است؟"),
    ("restriction", "hard", ["استثنا", "مگر", "فقط", "حداکثر", "ممنوع", "نباید"], "چه محدودیت یا استثنایی دربارهٔ «{topic}» آمده است؟"),
    ("deadline", "easy", ["حداکثر", "مهلت", "ظرف", "روز کاری", "موعد"], "مهلت مربوط به «{topic}» چقدر است؟"),
    ("multi_step", "hard", ["باید", "لازم", "مراحل", "ابتدا", "سپس"], "مراحل انجام «{topic}» طبق سند چیست؟"),
    ("multi_hop", "hard", [], "با توجه به بخش‌های مرتبط سند، دربارهٔ «{topic}» چه نتیجه‌ای گرفته می‌شود؟"),
    ("cross_section", "hard", [], "با توجه به بخش‌های مرتبط سند، دربارهٔ «{topic}» چه نتیجه‌ای گرفته می‌شود؟"),
]
#: The questions of the first two categories, of which one is drawn; openings of padded questions; other texts.
GENERAL = ["طبق سند، دربارهٔ «{topic}» چه مطلبی آمده است؟", "سیاست مرتبط با «{topic}» چگونه بیان شده است؟", "متن سیاست در مورد «{topic}» چه می‌گوید؟"]
DEFINED, DEFINES = "تعریف «{topic}» در این سند چیست؟", ["عبارت است", "به معنای", "تعریف"]
OPENINGS = ["بر اساس سند، ", "طبق سیاست، ", "با توجه به متن، "]
NO_TOPIC, DENIED = "این موضوع", ["نیست", "نمی", "ممنوع"]
NUMBER_ANSWER = "بر اساس سند، مقدار ذکرشده {number} است."
HEAD_QUESTION = "بر اساس سند، دربارهٔ موضوع زیر چه اطلاعاتی آمده است: {head}…؟"


def _fill(form: str, **parts: Column) -> Column:
    out = F.lit(form)
    for name, x in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), x)
    return out


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(T.words(words), lambda w: F.contains(text, w)) if words else F.lit(True)


def _draw(n: int, *key: Column | str) -> Column:
    """0 to n - 1 by a checksum of the key (the reference draws at random)."""
    return (F.crc32(F.concat_ws("|", *key).cast("binary")) % n).cast("int")


#: What can be asked of a sentence, by the bit of `probes`: the turn of its category and the form of its question.
FORMS = [*dict.fromkeys([*GENERAL, DEFINED, *(a[3] for a in ASKED if a[3]), HEAD_QUESTION.replace("{head}", "{topic}")])]
HEAD, HEAD_FORM, TWO = len(ASKED), len(FORMS) - 1, [n for n, a in enumerate(ASKED) if a[0] in ("multi_hop", "cross_section")]
OPTIONS = [(n, FORMS.index(f)) for n, a in enumerate(ASKED) for f in (GENERAL if a[3] is None else [a[3], DEFINED] if a[0] == "definition" else [a[3]])] + [(HEAD, HEAD_FORM)]
#: A question's place in its document, in one number: chunk (counted from the last), sentence of the chunk, turn.
_CHUNK, _AT = 1 << 32, 1 << 5


def _from_last() -> WindowSpec:
    return W.partitionBy("document_id").orderBy(F.desc("chunk_index"), F.desc("chunk_id"))


def _by_document(rows: DataFrame) -> DataFrame:
    """The rows of a document together, for all that follows: in a number of tasks that is given, as each row becomes many."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "document_id")


def probes(chunks: DataFrame, seed: int = 42) -> DataFrame:
    """Q03: the questions that each sentence of 25 characters or more gives rise to, one for each category whose words it holds.

    Chunks: document_id, chunk_id, chunk_index, text. Result: document_id, chunk_id, chunk_index, at (of the sentence), topic, options
    (bits of OPTIONS); questions over two sections need a next chunk too. A chunk without such sentences is one row, with the beginning of its text as the topic where it can be asked about."""
    found = F.filter(F.transform(T.sentences("text"), lambda x, i: F.struct(i.alias("at"), x.alias("sentence"))), lambda s: F.length(s["sentence"]) >= 25)
    head = T.strip(F.substring("text", 1, 280))
    rows = chunks.select("document_id", "chunk_id", "chunk_index", "text", found.alias("found"))
    rows = rows.select("document_id", "chunk_id", "chunk_index", F.when((F.coalesce(F.size("found"), F.lit(0)) <= 0) & (F.length(head) >= 20), F.substring(head, 1, 48)).alias("head"), "found")
    rows = rows.select("document_id", "chunk_id", "chunk_index", "head", F.explode_outer("found").alias("s")).select("document_id", "chunk_id", "chunk_index", "head", "s.at", "s.sentence")
    x, fits, before = c("sentence"), {}, {}
    for turn, (name, _, words, form) in enumerate(ASKED):
        if form and any(w in ([], words) for w in before.setdefault(form, [])):
            continue  # the same question as that of a turn before, of the same sentence
        before.setdefault(form, []).append(words)
        here = F.size(T.number_runs(x)) > 0 if name == "numerical" else _any(x, words)
        if form is None:
            drawn = _draw(len(GENERAL), F.lit(str(seed)), c("document_id").cast("string"), c("chunk_id").cast("string"), c("at").cast("string"), F.lit(name))
            fits |= {(turn, n): here & (drawn == n) for n in range(len(GENERAL))}
        elif name == "definition":
            fits |= {(turn, FORMS.index(DEFINED)): _any(x, DEFINES), (turn, FORMS.index(form)): ~_any(x, DEFINES)}
        else:
            fits[turn, FORMS.index(form)] = here
    bits = reduce(Column.bitwiseOR, (F.when(fit, F.lit(1 << OPTIONS.index(option))).otherwise(0) for option, fit in fits.items()))
    topic = F.coalesce(F.try_element_at(T.keywords(x), F.lit(1)), F.lit(NO_TOPIC))
    options = F.when(x.isNotNull(), bits).when(c("head").isNotNull(), 1 << len(OPTIONS) - 1).otherwise(0)
    return rows.select("document_id", "chunk_id", "chunk_index", "at", F.when(x.isNotNull(), topic).otherwise(c("head")).alias("topic"), options.alias("options"))


def _chosen_of(found: DataFrame, least: int, most: int, seed: int) -> DataFrame:
    """document_id, asked: of each document its questions (ordinal, padded, left: chunks from its own to the last, at, turn, form, topic), `most` or fewer."""
    of = lambda n: F.get(F.array(*(F.lit(o[n]) for o in OPTIONS)), c("option"))
    only_two = sum(1 << n for n, (turn, _) in enumerate(OPTIONS) if turn in TWO)
    rows = _by_document(found).withColumn("left", F.dense_rank().over(_from_last()))
    own = F.when(c("left") == 1, c("options").bitwiseAND(~only_two)).otherwise(c("options"))
    rows = rows.select("document_id", "topic", "left", "at", own.alias("options"))
    rows = rows.select("document_id", "topic", "left", "at", F.explode(F.array_compact(F.array(*(F.when(c("options").bitwiseAND(1 << n) != 0, n) for n in range(len(OPTIONS)))))).alias("option"))
    place = (F.lit((1 << 31) - 1) - c("left")).cast("bigint") * _CHUNK + F.coalesce("at", F.lit(0)).cast("bigint") * _AT + of(0)
    rows = rows.select("document_id", "topic", of(1).alias("form"), place.alias("place"))
    once = rows.groupBy("document_id", "topic", "form", F.when(c("form") == HEAD_FORM, c("place")).alias("head")).agg(F.min("place").alias("place"))
    once = once.select("document_id", "topic", "form", "place", (c("place") % _AT).cast("int").alias("turn")).withColumn("question", _question())
    order = W.partitionBy("document_id", "turn").orderBy(F.crc32(c("question").cast("binary")), "question", "place")
    kept = once.withColumn("round", F.row_number().over(order)).where(c("round") <= most + 1)  # one more tells that there are more
    rows = kept.groupBy("document_id").agg(F.collect_list(F.struct("round", "turn", "place", "form", "topic")).alias("q"))
    rows = rows.withColumn("q", F.when(F.exists("q", lambda q: q["turn"] < HEAD), F.filter("q", lambda q: q["turn"] < HEAD)).otherwise(c("q")))
    document = c("document_id").cast("string")
    rows = rows.withColumns({"target": least + _draw(most - least + 1, F.lit(str(seed)), document), "n": F.size("q")})
    sampled = lambda x: F.when(c("n") > c("target"), x).otherwise(0)
    place = lambda q: F.struct(sampled(q["round"]).alias("round"), sampled(q["turn"]).alias("rotation"), q["place"].alias("place"), q["turn"].alias("turn"), q["form"].alias("form"), q["topic"].alias("topic"))
    rows = rows.select("document_id", "n", "target", F.slice(F.array_sort(F.transform("q", place)), F.lit(1), c("target")).alias("q"))
    asked = lambda q, ordinal, padded: F.struct(
        ordinal.cast("bigint").alias("ordinal"), F.lit(padded).alias("padded"), (F.lit((1 << 31) - 1) - F.shiftright(q["place"], 32)).cast("int").alias("left"),
        F.shiftright(q["place"].bitwiseAND(_CHUNK - 1), 5).cast("int").alias("at"), q["turn"].alias("turn"), q["form"].alias("form"), q["topic"].alias("topic"))
    pick = lambda o: F.get("q", (_draw(1 << 30, F.lit(str(seed)), document, o.cast("string")) % c("n")).cast("int"))
    more = F.when(c("n") < c("target"), F.sequence(c("n") + 1, c("target"))).otherwise(F.array().cast("array<int>"))
    return rows.select("document_id", F.concat(F.transform("q", lambda q, i: asked(q, i + 1, False)), F.transform(more, lambda o: asked(pick(o), o, True))).alias("asked"))


def _question() -> Column:
    return _fill(F.get(F.array(*map(F.lit, FORMS)), c("form")), topic=c("topic"))


def answered(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The questions of `_chosen_of`, one a row, with chunk_id, category, question, difficulty, answer, passage, citation and notes.

    The chunks of a document meet its list of questions, and leave with their own."""
    rows = _by_document(chunks.select("document_id", "chunk_id", "chunk_index", "text"))
    rows = rows.withColumns({"left": F.dense_rank().over(_from_last()), "next_id": F.lag("chunk_id").over(_from_last()).cast("string"), "next_head": F.lag(F.substring("text", 1, 220)).over(_from_last())})
    rows = rows.join(asked, "document_id").withColumn("asked", F.filter("asked", lambda q: q["left"] == c("left"))).where(F.size("asked") > 0)
    two = lambda turn: turn.isin(TWO)
    opening = lambda turn, x: F.when(turn == HEAD, T.strip(F.substring("text", 1, 280))).when(F.length(x) < 40, F.substring("text", 1, 400))
    held = lambda q, x: F.struct(q.alias("q"), F.when(q["turn"] < HEAD, x).alias("sentence"), opening(q["turn"], x).alias("opening"), F.when(two(q["turn"]), c("next_head")).alias("next_head"))
    own = T.let(T.sentences("text"), lambda parts: F.transform("asked", lambda q: held(q, F.get(parts, q["at"]))))
    rows = rows.select("document_id", "chunk_id", "next_id", own.alias("own")).select("document_id", "chunk_id", "next_id", F.explode("own").alias("s"))
    rows = rows.select("document_id", "chunk_id", "next_id", "s.q.*", "s.sentence", "s.opening", "s.next_head")
    x, turn = c("sentence"), c("turn")
    of = lambda *names: turn.isin([n for n, a in enumerate(ASKED) if a[0] in names])
    passage = F.coalesce("opening", x)
    whole = F.when(two(turn), F.concat(passage, F.lit("\n"), "next_head")).otherwise(passage)
    answer = (F.when(of("numerical"), _fill(NUMBER_ANSWER, number=F.try_element_at(T.number_runs(x), F.lit(1))))
              .when(of("yes_no"), F.concat(F.when(_any(x, DENIED), "خیر").otherwise("بله"), F.lit(". "), passage)).otherwise(whole))
    opening = F.get(F.array(*map(F.lit, OPENINGS)), _draw(len(OPENINGS), F.lit("opening"), c("document_id").cast("string"), c("ordinal").cast("string")))
    opened = F.exists(T.words(OPENINGS), lambda o: F.startswith("question", o))
    rows = rows.withColumn("question", _question())
    notes = F.when(two(turn), F.concat(F.lit("multi_section_with_chunk="), "next_id"))
    return rows.select(
        "document_id", "chunk_id", "ordinal", F.get(F.array(*(F.lit(a[0]) for a in ASKED), F.lit("factual")), turn).alias("category"),
        F.when(c("padded") & ~opened, F.concat(opening, F.ltrim("question"))).otherwise(c("question")).alias("question"),
        F.when(c("padded"), "medium").otherwise(F.get(F.array(*(F.lit(a[1]) for a in ASKED), F.lit("easy")), turn)).alias("difficulty"),
        T.strip(answer).alias("answer"), T.strip(whole).alias("passage"), T.strip(F.when(two(turn), F.substring(passage, 1, 180)).otherwise(F.substring(passage, 1, 220))).alias("citation"),
        F.when(c("padded"), F.concat(F.coalesce(notes, F.lit("")), F.lit(";padded"))).otherwise(notes).alias("notes"))


def ground_truth(chunks: DataFrame, least: int = 40, most: int = 60, seed: int = 42) -> DataFrame:
    """Q03, Q04: questions of each document, as many as a draw between `least` and `most` says: id, document_id, chunk_id, ordinal, tags and what `answered` gives.

    Equal questions of a document count once, the first. Of more than its number a document keeps, in rotation over the
    categories, one of each as long as there are some, in an order by checksum; fewer are padded by the same questions
    with an opening. A document whose sentences give nothing is asked about the heads of its chunks. Questions are chosen as
    topics and forms of their sentences: two shuffles, one of a short row a sentence and one of the chunks, which are read twice. Of a large document only `most` and one of each category meet."""
    out = answered(_chosen_of(probes(chunks, seed), least, most, seed), chunks)
    number = F.concat(F.lit("fa-"), F.substring(c("document_id").cast("string"), 1, 8), F.lit("-"), F.when(c("ordinal") < 1000, F.lpad(c("ordinal").cast("string"), 3, "0")).otherwise(c("ordinal").cast("string")))
    out = out.withColumns({"id": number, "tags": F.array_sort(F.array_distinct(F.array(c("category"), F.lit("fa"), F.lit("auto_corpus_probe"), F.lit("persian_benchmark"))))})
    return out.select("id", "document_id", "chunk_id", "ordinal", "category", "difficulty", "question", "answer", "passage", "citation", "notes", "tags")


#: Q05, fixed values: words for words, openings and spellings.
SYNONYMS = [("کارکنان", "پرسنل"), ("پرسنل", "کارمندان"), ("کارمند", "پرسنل"), ("مرخصی", "مرخصی استحقاقی"), ("سازمان", "شرکت"), ("مدیر", "سرپرست"), ("روز کاری", "روز کاری اداری")]
PARAPHRASES = [("چند", "چه تعداد"), ("چیست", "چه می‌باشد"), ("چگونه", "به چه صورت")]
SPELLINGS = [("می‌", "مي‌"), ("ها", " های"), ("است", " هست")]
FORMAL, PLEASE = "خواهشمند است مشخص فرمایید که ", "لطفاً توضیح دهید: "


def _once(text: Column, wrong: str, right: str) -> Column:
    """The first occurrence replaced."""
    head = F.substring_index(text, wrong, 1)
    return F.when(F.contains(text, F.lit(wrong)), F.concat(head, F.lit(right), F.substr(text, F.length(head) + len(wrong) + 1))).otherwise(text)


def _chosen(key: Column, options: list[Column]) -> Column:
    """One of the options by a hash of the key (the reference draws at random)."""
    return F.get(F.array(*options), F.pmod(F.xxhash64(key), F.lit(len(options))).cast("int"))


def variants(questions: DataFrame, keep: int = 8) -> DataFrame:
    """Q05: question_id, kind, text: thirteen kinds of altered wordings, those that differ, at most `keep` of each question."""
    q = c("question")
    held = F.filter(F.array(*(F.when(F.contains(q, F.lit(w)), _once(q, w, r)) for w, r in SYNONYMS)), lambda x: x.isNotNull())
    soft = F.replace(F.replace(q, F.lit("می‌باشد"), F.lit("هست")), F.lit("است؟"), F.lit("ه؟"))
    kinds = {
        "paraphrase": _chosen(q, [*(_once(q, w, r) for w, r in PARAPHRASES), F.concat(F.lit(PLEASE), q)]),
        "formal": F.concat(F.lit(FORMAL), F.rtrim(q, F.lit("؟")), F.lit("؟")),
        "informal": F.when(F.endswith(soft, F.lit("؟")), soft).otherwise(F.concat(soft, F.lit("؟"))),
        "synonym": F.when(F.size(held) > 0, F.get(held, F.pmod(F.xxhash64(q), F.greatest(F.size(held), F.lit(1))).cast("int"))),
        "arabic_yeh_kaf": T.arabic_letters(q), "halfspace": T.with_half_spaces(T.without_half_spaces(q)),
        "digit_latin": T.to_latin_digits(q), "digit_persian": T.to_persian_digits(q), "digit_arabic_indic": T.to_arabic_digits(q),
        "punctuation": T.noisy_punctuation(q), "no_punctuation": T.without_punctuation(q), "whitespace": T.collapse_spaces(F.regexp_replace(q, r"\s", "  ")),
        "spelling": _chosen(q, [F.when(F.contains(q, F.lit(w)), _once(q, w, r)) for w, r in SPELLINGS]),
    }
    rows = questions.select("question_id", "question", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in kinds.items()))).alias("v")).select("question_id", "question", "v.*").where((F.trim("text") != F.trim("question")) & (c("text") != ""))
    order = W.partitionBy("question_id").orderBy(F.xxhash64("question_id", "kind"), "kind")
    return rows.withColumn("r", F.row_number().over(order)).where(c("r") <= keep).select("question_id", "kind", "text")


def cohorts(rows: DataFrame) -> DataFrame:
    """Q06: cohort, and whether a question counts as measured."""
    return rows.withColumns({"cohort": F.when(c("kind").isNull(), "baseline").otherwise("robustness"), "measured": c("chunk_id").isNotNull() & ~F.coalesce(c("expect_abstention"), F.lit(False))})
