"""Text analysis: normalization, tokens, stopwords, stems and bags of words.

Tokens and their counts come from built-in expressions, inside the rows that hold the texts. Only stemming runs in
Python, on the distinct tokens of an Arrow batch.
"""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestar.functions import stem

OTHER = re.compile(r"[^\x00-\x7f]+")
ANALYZERS = ("spanish", "english", "raw")
#: A task remembers the stems of at most so many tokens.
REMEMBERED = 200_000
# The stopwords, without accents.
ENGLISH_STOPWORDS = (
    "a about after again against all am an and any are aren as at be because been before being below between both but by can cannot could couldn did didn do does doesn doing don down during each "
    "few for from further had hadn has hasn have haven having he her here hers herself him himself his how i if in into is isn it its itself just ll me more most mustn my myself no nor not now of off "
    "on once only or other our ours ourselves out over own re s same shan she should shouldn so some such t than that the their theirs them themselves then there these they this those through to too "
    "under until up ve very was wasn we were weren what when where which while who whom why will with won would wouldn you your yours yourself yourselves"
).split()
SPANISH_STOPWORDS = (
    "a al algo algunas algunos ante antes aquel aquella aquellas aquellos aqui asi aun aunque bajo bien cada casi como con contra cual cuales cualquier cuando cuanto de del desde donde dos durante e el "
    "ella ellas ello ellos en entre era erais eran eras eres es esa esas ese eso esos esta estaba estaban estado estais estamos estan estar estas este esto estos estoy etc fue fueron fui fuimos ha habeis "
    "haber habia habian han has hasta hay he hemos hizo hubo la las le les lo los mas me mi mia mias mientras mio mios mis mucha muchas mucho muchos muy nada ni no nos nosotras nosotros nuestra nuestras "
    "nuestro nuestros o os otra otras otro otros para pero poco por porque que quien quienes se sea sean segun ser si sido siempre siendo sin sino sobre sois solo somos son soy su sus suya suyas suyo "
    "suyos tal tambien tampoco tan tanto te tendra tenemos tener tengo ti tiene tienen toda todas todo todos tras tu tus tuya tuyas tuyo tuyos u un una unas uno unos usted ustedes va vamos van vosotras "
    "vosotros voy y ya yo"
).split()
STOPWORDS = {"english": ENGLISH_STOPWORDS, "spanish": SPANISH_STOPWORDS}
STEMMERS = {"english": stem.english, "spanish": stem.spanish}


def plain(text: str) -> str:
    """Lower case without combining marks."""
    if text.isascii():
        return text.lower()
    return OTHER.sub(lambda m: "".join(c for c in m[0] if not unicodedata.combining(c)), unicodedata.normalize("NFKD", text.lower()))


@F.pandas_udf(StringType())
def normalize(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else plain(t))


@cache
def _characters() -> tuple[dict[str, str], dict[str, str], str]:
    """What ``plain`` makes of single characters: of a-z and 0-9 one, of several characters with one among them, nothing.

    All else separates words, and is left alone or a blank here. ``plain`` works character by character but for the
    order of combining marks, which it drops.
    """
    one, several, gone = dict(zip(string.ascii_uppercase, string.ascii_lowercase)), {}, []
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if unicodedata.decomposition(c) or unicodedata.combining(c) or c.lower() != c:
            made = re.sub("[^a-z0-9]", " ", plain(c))
            if not made:
                gone.append(c)
            elif not made.isspace():
                (one if len(made) == 1 else several)[c] = made
    return one, several, "".join(gone)


def _class(characters: list[str]) -> str:
    """A regular expression for one of the characters, in ranges: Java tries the parts of a class one by one."""
    ranges: list[list[int]] = []
    for p in sorted(map(ord, characters)):
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


def without_accents(text: Column) -> Column:
    """A text with the words of its normalized form, by built-in expressions alone."""
    one, several, gone = _characters()
    some = _class(list(several))
    made = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spread = F.array_join(F.transform(F.split(text, f"(?<={some})|(?={some})"), lambda p: F.coalesce(made[p], p)), "")
    mapped = F.translate(F.when(text.rlike(some), spread).otherwise(text), "".join(one) + gone, "".join(one.values()))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(mapped)


def words(text: Column, accents: bool = True) -> Column:
    """Runs of a-z and 0-9 of the normalized text; without ``accents`` only case is folded."""
    return F.regexp_extract_all(without_accents(text) if accents else F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def content_words(text: Column, language: str, accents: bool = True) -> Column:
    """Words that are no stopwords, in order."""
    return F.filter(words(text, accents), lambda w: ~w.isin(STOPWORDS[language]))


def raw_terms(text: Column) -> Column:
    """(term, n) of white-space separated ``term`` or ``term:n``; case is kept."""
    parts = F.filter(F.split(text, r"\s+"), lambda p: F.substring_index(p, ":", 1) != "")
    number = lambda p: F.regexp_extract(p, r"^[^:]*:([0-9]+)$", 1)
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, ":", 1).alias("term"), F.when(number(p) != "", number(p).cast("long")).otherwise(F.lit(1).cast("long")).alias("n")))


def stemmer(language: str):
    """Arrays of tokens to arrays of stems."""
    one, known = STEMMERS[language], {}

    def stem_of(token: str) -> str:
        found = known.get(token)
        if found is None:
            if len(known) >= REMEMBERED:
                known.clear()
            found = known[token] = one(token)
        return found

    @F.arrow_udf(ArrayType(StringType()))
    def stems(tokens: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        flat = tokens.flatten().dictionary_encode()
        made = pa.array([stem_of(t) for t in flat.dictionary.to_pylist()], pa.string())
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), made.take(flat.indices))

    return stems


def tally(docs: DataFrame, id_col: str, terms: Column, counted: bool = False) -> DataFrame:
    """(id, term, tf): one row per id and term of an array of terms, or, if ``counted``, of (term, n).

    Counts are made inside a row: the runs of its sorted terms. Only ids that several rows have need a shuffle.
    """
    rows = docs.select(F.col(id_col), F.sort_array(F.coalesce(terms, F.array())).alias("_terms"))
    term = (lambda i: F.get("_terms", i)["term"]) if counted else (lambda i: F.get("_terms", i))
    places = F.when(F.size("_terms") > 0, F.sequence(F.lit(0), F.size("_terms") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_starts", F.filter(places, lambda i: ~term(i).eqNullSafe(term(i - 1))))
    end = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_terms"))
    total = lambda i, k: F.aggregate(F.slice("_terms", i + 1, end(k) - i), F.lit(0).cast("long"), lambda n, t: n + t["n"]) if counted else (end(k) - i).cast("long")
    runs = F.transform("_starts", lambda i, k: F.struct(term(i).alias("term"), total(i, k).alias("tf")))
    # for explode, Spark would filter empty arrays first, with all of this written into the lambda once more for each element
    out = rows.select(id_col, F.explode_outer(runs).alias("t")).where("t is not null").select(id_col, "t.term", "t.tf")
    repeated = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out if repeated.isEmpty() else out.groupBy(id_col, "term").agg(F.sum("tf").alias("tf"))


def bag_of_words(docs: DataFrame, id_col: str, text_col: str, analyzer: str = "spanish") -> DataFrame:
    """(id, term, tf): one row per document and term. Null texts have no terms."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer {analyzer!r}: use one of {', '.join(ANALYZERS)}")
    if analyzer == "raw":
        return tally(docs, id_col, raw_terms(F.col(text_col)), counted=True).where("tf > 0")
    return tally(docs, id_col, stemmer(analyzer)(content_words(F.col(text_col), analyzer)))


def query_terms(text: str, analyzer: str = "spanish") -> list[str]:
    """The terms of a query, as the analyzer makes them of a document; repeats stay."""
    if analyzer == "raw":
        out = []
        for part in text.split():
            term, _, n = part.partition(":")
            out += [term] * (int(n) if n.isdigit() else 1) if term else []
        return out
    stop = set(STOPWORDS[analyzer])
    return [STEMMERS[analyzer](w) for w in re.findall("[a-z0-9]+", plain(text)) if w not in stop]
