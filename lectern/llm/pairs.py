"""Broken prompt and response pairs: each defective pair with one type of defect.

Responses are sorted by text; a response that begins its neighbour is a shortened version. Length-limit spikes and
the endings that the corpus knows find the other broken-off ones. Copy, refusal and language rules follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.endings import ITEM, Endings, ending_counts
from lectern.llm.language import language, requested, unquoted
from lectern.llm.textutil import words
from lectern.llm.truncation import LIKELY, SURE, length_spikes
from lectern.session import cut

# Placeholders, and the ways in which an answer declines, in the first person or impersonally.
PLACEHOLDER = re.compile(r"(?:n\s*/?\s*a|null|none|nil|nan|undefined|todo|tbd|tba|fixme|xxx+|empty|blank|placeholder|no answer|not available|unknown|keine antwort|keine angabe|k\s*a|sans réponse|pas de réponse|sin respuesta|vacío|leer|vide|answer|antwort|réponse|respuesta|text|lorem ipsum|pending|missing|error)", re.I)
REFUSAL = re.compile(
    r"""\bI(?:['’]m|\ am)?\ (?:really\ )?(?:can(?:no|['’]?)t|can\ not|could\ not|couldn['’]t|am\ unable|unable|am\ not\ able|not\ able|am\ not\ (?:allowed|permitted|comfortable)|not\ (?:allowed|permitted|comfortable)|won['’]t|will\ not|must\ (?:decline|refuse)|have\ to\ (?:decline|refuse|stay\ out|pass)|need\ to\ decline|decline|refuse|prefer\ not|would\ (?:rather|prefer)\ not)
    |\bI['’]d\ (?:rather|prefer)\ not|\bI\ must\ decline|\bas\ an?\ (?:AI|assistant|language\ model)|\bno\ comment\b|outside\ (?:of\ )?what\ I\ am\ allowed|request\ has\ been\ (?:blocked|refused|declined)|(?:against|violates?)\ (?:my|our|the)\ (?:guidelines|policy|policies|rules)|have\ to\ ask\ someone\ else|(?:guidelines|policy|rules)\ (?:do\ not|don['’]t)\ (?:allow|permit)
    |\b(?:kann|darf|möchte|will|werde)\ (?:ich\ )?(?:\w+\ ){0,6}?nicht\b|\bich\ (?:kann|darf|möchte|will|werde)\b[^.]{0,60}\bnicht\b|nicht\ befugt|bin\ nicht\ (?:berechtigt|in\ der\ Lage)|Richtlinien\ (?:lassen|erlauben)|lehne\b[^.]{0,40}\bab\b|muss\ ich\ (?:leider\ )?ablehnen|darf\ nicht\ beantwort|gebe\ ich\ keine\ Auskunft|dazu\ äußere\ ich\ mich\ nicht
    |\bje\ ne\ (?:peux|suis|souhaite|veux|puis|répond\w*)\b[^.]{0,30}|\bje\ (?:préfère|préférerais)\ ne\ pas|\bje\ (?:dois\ )?(?:refuse|décline|refuser|décliner)|ne\ serait\ pas\ approprié|(?:règles|consignes|directives)\ ne\ (?:me\ )?(?:permettent|autorisent)|m['’]est\ (?:pas\ permis|impossible)|demande\ a\ été\ (?:bloquée|refusée)
    |\bno\ (?:puedo|debo|quiero|voy\ a|me\ es\ posible|estoy\ (?:autorizad|en\ condiciones)|tengo\ permitido|sería\ apropiad|sería\ adecuad)|\bprefiero\ no|\b(?:debo|tengo\ que)\ (?:rechazar|declinar|negarme)|\bme\ niego|(?:normas|directrices|reglas)\ no\ (?:me\ )?(?:permiten|dejan)|solicitud\ ha\ sido\ (?:bloqueada|rechazada)
    |(?:my|our|the)\ (?:guidelines|policy|policies|rules|instructions)\ (?:keep|prevent|stop|forbid)|would\ (?:not|n['’]t)\ be\ (?:appropriate|right|responsible)|wouldn['’]t\ be\ appropriate|against\ (?:my\ |our\ |the\ )?(?:policy|policies|rules|guidelines)|outside\ (?:of\ )?what\ I
    |(?:Richtlinien|Vorgaben|Regeln)\ (?:verbieten|untersagen|verhindern|hindern)|(?:wäre|ist)\ (?:es\ )?(?:nicht\ angemessen|unangemessen|nicht\ angebracht)|außerhalb\ dessen
    |(?:consignes|règles|directives)\ m['’]interdisent|sort\ de\ ce\ que\ j['’]ai\ le\ droit|ne\ (?:me\ )?prononcer|(?:normas|directrices|instrucciones|pautas)\ me\ (?:impiden|prohíben)|fuera\ de\ lo\ que\ (?:puedo|se\ me)|no\ (?:sería|es)\ (?:apropiad|adecuad|correct)
    |お答えできません|回答できません|お手伝いできません|お答えすることはできません""",
    re.I | re.X,
)
NOTHING = re.compile(r"library|bibliothek|bibliothèque|biblioteca|archiv|transcri|ライブラリ", re.I)
LEAD = re.compile(r"^\s*(?:answer|antwort|réponse|respuesta|a|question|frage|pregunta|q)\s*[:：]\s*", re.I)
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
#: Answers of fewer words are short for telling their language.
SHORT = 5
#: An answer in prose that leaves its sentence open is broken off unless the corpus often ends so.
UNCLOSED = 0.5


def is_empty(answer: str | None) -> bool:
    """Null, blank, signs only, or a mere placeholder."""
    if answer is None:
        return True
    core = " ".join(re.findall(r"[^\W_]+(?:/[^\W_]+)*", answer)).strip()
    return not core or bool(PLACEHOLDER.fullmatch(core))


def is_copy(question: str | None, answer: str) -> bool:
    """The answer gives back the question, wholly or nearly, and nothing more."""
    if not question:
        return False
    q, a = words(LEAD.sub("", question)), words(LEAD.sub("", answer))
    if not q or not a or len(a) > 1.35 * len(q) + 2 or len(a) < 3:
        return False
    if q == a:
        return True
    same = sum(m.size for m in SequenceMatcher(None, q, a, autojunk=False).get_matching_blocks())
    return same >= 0.8 * len(a) and same >= 0.6 * len(q) and len(a) - same <= 3


def is_refusal(answer: str) -> bool:
    """The answer as a whole declines; a quoted refusal or a statement that nothing is held on the matter does not count."""
    text = unquoted(answer).strip()
    parts = [p for p in SENTENCE.split(text) if p.strip()]
    if not parts:
        return False
    if sum(len(words(p)) for p in parts) > 60:
        return False
    declines = lambda p: bool(REFUSAL.search(p)) and not (NOTHING.search(p) and not re.search(r"\b(?:I|ich|je)\b", p))
    if not any(map(declines, parts[:2])):
        return False
    return sum(len(words(p)) for p in parts if not declines(p)) <= 14


def is_foreign(question: str | None, answer: str) -> bool:
    """The answer is in another language than the question, and not in one that the question asks for."""
    if not question:
        return False
    body = LEAD.sub("", unquoted(answer))
    # a name or a lone word tells no language: short answers need two words of it
    tells = lambda t: language(t, 2.0, 1 if len(words(t)) >= SHORT else 2)
    got = tells(body) or (tells(answer) if len(words(body)) < 4 else None)
    own = language(question)
    return bool(got and own and got != own and got not in requested(question))


def judge(question: str | None, answer: str | None, complete: float) -> str | None:
    """The one defect that a pair shows by itself, or None."""
    if is_empty(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if is_foreign(question, answer):
        return "wrong_language"
    last = answer.rstrip().rsplit("\n", 1)[-1]
    prose = not ITEM.match(last) and len(words(last)) >= 6  # a sentence left without its end; list items need none
    if complete < SURE or (prose and complete < UNCLOSED):
        return "truncated"
    return None


def BARE(column: str) -> Column:  # noqa: N802
    """A text without the whitespace and dots that it ends in."""
    return F.regexp_replace(column, r"(?U)(?:\s|\.{3}|…)+$", "")


def shortened_versions(answers: DataFrame) -> DataFrame:
    """Distinct texts that begin another one: (text), by sorting and comparing neighbours' common prefixes.

    Texts are ranged by their whole text, so a common opening of many is divided over tasks; the first text of each range is
    compared with the last one of the range before (one text a range travels for that). A text that begins any other also begins
    its neighbour. Nulls and blank texts are left out.
    """
    texts = answers.select(BARE("text").alias("text")).where(F.length("text") > 0).distinct()
    ordered = cut(texts.repartitionByRange("text").sortWithinPartitions("text").withColumn("_part", F.spark_partition_id()))
    firsts = ordered.groupBy("_part").agg(F.min("text").alias("text"))
    after = Window.partitionBy(F.lit(0)).orderBy("_part")
    edges = ordered.groupBy("_part").agg(F.max("text").alias("text")).join(firsts.withColumnRenamed("text", "_first"), "_part")
    edges = edges.select("text", F.lead("_first").over(after).alias("_next")).where(F.col("_next").startswith(F.col("text"))).select("text")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: str | None = None
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if last is not None and text.startswith(last):
                    out.append(last)
                last = text
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["text"])

    within = ordered.select("text").sortWithinPartitions("text").mapInArrow(neighbours, "text string")
    return within.unionByName(edges).distinct()


def pair_defects(jobs: DataFrame, *, id_col: str = "id", question_col: str = "question", answer_col: str = "answer.answer") -> DataFrame:
    """Defective pairs: (id, defect), one row per distinct row; sound pairs do not come out.

    defect is 'empty' (null, blank, placeholder), 'copy', 'refusal', 'wrong_language' or 'truncated', tested in this order. A
    null question can only make an answer empty, refused or truncated. An empty table gives no rows. Very long answers
    are read whole.
    """
    pairs = jobs.select(F.col(id_col).cast("long").alias("id"), F.col(question_col).alias("question"), F.col(answer_col).alias("answer"))
    filled = pairs.where(F.col("answer").isNotNull())
    counts = ending_counts(filled.select("answer"))
    shared = jobs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = Endings(shared.value)
        for batch in batches:
            answers = batch.column(2).to_pylist()
            complete = [1.0 if a is None else endings(a) for a in answers]
            defects = [judge(q, a, c) for q, a, c in zip(batch.column(1).to_pylist(), answers, complete, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(complete, pa.float64()), pa.array(defects, pa.string())], ["id", "length", "bare", "complete", "defect"])

    keyed = pairs.select("id", "question", "answer", F.length(F.rtrim("answer")).alias("length"), F.xxhash64(BARE("answer")).alias("bare"))
    judged = cut(keyed.mapInArrow(run, "id long, length int, bare long, complete double, defect string"))
    # only what stays doubtful needs limits and longer versions
    spikes = length_spikes(judged.where("defect is null or defect = 'truncated'")).select("length", F.lit(True).alias("at_limit"))
    shorter = shortened_versions(filled.select(F.col("answer").alias("text"))).select(F.xxhash64("text").alias("bare"), F.lit(True).alias("shortened"))
    sure, doubtful = judged.where("defect is not null"), judged.where((F.col("defect").isNull()) & (F.col("complete") < LIKELY))
    broken = doubtful.join(spikes, "length", "left").join(shorter, "bare", "left").where("at_limit or shortened")
    return sure.select("id", "defect").unionByName(broken.select("id", F.lit("truncated").alias("defect"))).distinct()
