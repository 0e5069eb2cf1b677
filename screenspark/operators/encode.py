"""Spark ML stages that turn screening rows into model features.

Fitted state is small (a vocabulary, a few numbers) and kept in params, so the
stages save and load with the pipeline. Transforming a row needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.functions.scalars import as_text, known_number, level_match
from screenspark.functions.text import join_texts, let, ngrams, plain_words, skill_overlap, tokens
from screenspark.names import col, cols, free_name
from screenspark.operators.prefix import quantiles
from screenspark.operators.tfidf import TfidfSpec, vocabulary

# Spark's encoder refuses the empty string as a category.
EMPTY_CATEGORY = "__empty__"
ANALYZERS = {"plain": plain_words, "no_stop_words": tokens}


def _text(df: DataFrame, name: str) -> Column:
    return as_text(col(name)) if name in df.columns else F.lit("")


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    pass


class TypeCoercion(Transformer, HasInputCols, _Stage):
    """Present columns become strings without nulls; ``emptyAs`` replaces the empty string."""

    emptyAs = Param(Params._dummy(), "emptyAs", "spelling of the empty string", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, emptyAs: str = ""):
        super().__init__()
        self._setDefault(emptyAs="", inputCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        empty = self.getOrDefault(self.emptyAs)
        present = [c for c in self.getInputCols() if c in df.columns]

        def clean(c: str) -> Column:
            text = as_text(col(c))
            return F.when(text == "", F.lit(empty)).otherwise(text) if empty else text

        return df.withColumns({c: clean(c) for c in present})


class _PairStage(Transformer, HasOutputCol, _Stage):
    jobCol = Param(Params._dummy(), "jobCol", "column of the job", TypeConverters.toString)
    candidateCol = Param(Params._dummy(), "candidateCol", "column of the candidate", TypeConverters.toString)

    def _pair(self, df: DataFrame) -> tuple[Column, Column]:
        return _text(df, self.getOrDefault(self.jobCol)), _text(df, self.getOrDefault(self.candidateCol))


class LevelMatch(_PairStage):
    """1.0 where the academic levels are equal, else 0.0."""

    @keyword_only
    def __init__(self, *, jobCol=None, candidateCol=None, outputCol="match_nivel_academico"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(outputCol="match_nivel_academico")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), level_match(*self._pair(df)).cast("double"))


class SkillOverlap(_PairStage):
    """Jaccard overlap of required and offered skills."""

    @keyword_only
    def __init__(self, *, jobCol=None, candidateCol=None, outputCol="overlap_skills"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(outputCol="overlap_skills")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), skill_overlap(*self._pair(df)))


class TextConcat(Estimator, HasInputCols, HasOutputCol, _Stage):
    """Learns which of the text columns exist, then joins them into one."""

    sep = Param(Params._dummy(), "sep", "text between two columns", TypeConverters.toString)
    dropOriginal = Param(Params._dummy(), "dropOriginal", "drop the joined columns", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="text_concat", sep=" ", dropOriginal=False):
        super().__init__()
        self._setDefault(outputCol="text_concat", sep=" ", dropOriginal=False, inputCols=[])
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> TextConcatModel:
        return TextConcatModel(
            inputCols=[c for c in self.getInputCols() if c in df.columns],
            outputCol=self.getOutputCol(),
            sep=self.getOrDefault(self.sep),
            dropOriginal=self.getOrDefault(self.dropOriginal),
        )


class TextConcatModel(Model, HasInputCols, HasOutputCol, _Stage):
    sep = TextConcat.sep
    dropOriginal = TextConcat.dropOriginal

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="text_concat", sep=" ", dropOriginal=False):
        super().__init__()
        self._setDefault(outputCol="text_concat", sep=" ", dropOriginal=False, inputCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        present = [c for c in self.getInputCols() if c in df.columns]
        joined = df.withColumn(self.getOutputCol(), join_texts(cols(present), self.getOrDefault(self.sep)))
        return joined.drop(*present) if self.getOrDefault(self.dropOriginal) else joined


class _VocabularyParams(Params):
    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms to keep", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "documents, or share below 1", TypeConverters.toFloat)
    maxDF = Param(Params._dummy(), "maxDF", "share of documents up to 1, else documents", TypeConverters.toFloat)
    ngramMin = Param(Params._dummy(), "ngramMin", "shortest word run", TypeConverters.toInt)
    ngramMax = Param(Params._dummy(), "ngramMax", "longest word run", TypeConverters.toInt)
    analyzer = Param(Params._dummy(), "analyzer", "plain or no_stop_words", TypeConverters.toString)

    def spec(self) -> TfidfSpec:
        low, high = self.getOrDefault(self.minDF), self.getOrDefault(self.maxDF)
        return TfidfSpec(
            max_features=self.getOrDefault(self.maxFeatures),
            min_df=int(low) if low >= 1 else low,
            max_df=int(high) if high > 1 else high,
            ngram_min=self.getOrDefault(self.ngramMin),
            ngram_max=self.getOrDefault(self.ngramMax),
            words=ANALYZERS[self.getOrDefault(self.analyzer)],
        )


class _TermsParams(Params):
    terms = Param(Params._dummy(), "terms", "vocabulary in index order", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "weight per term", TypeConverters.toListFloat)
    ngramMin = _VocabularyParams.ngramMin
    ngramMax = _VocabularyParams.ngramMax
    analyzer = _VocabularyParams.analyzer

    def _unit_vectors(self, df: DataFrame, texts: Mapping[str, Column]) -> DataFrame:
        """Add one L2-normalised TF-IDF vector column per text."""
        words = ANALYZERS[self.getOrDefault(self.analyzer)]
        low, high = self.getOrDefault(self.ngramMin), self.getOrDefault(self.ngramMax)
        known = self.getOrDefault(self.terms)
        if not known:
            zero = F.array_repeat(F.lit(0.0), 1)
            return df.withColumns({out: array_to_vector(zero) for out in texts})
        counter = CountVectorizerModel.from_vocabulary(known, inputCol="_words", outputCol="_counts")
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense(self.getOrDefault(self.idf)), inputCol="_counts", outputCol="_scaled"
        )
        for out, text in texts.items():
            df = df.withColumn("_words", ngrams(words(text), low, high))
            scaled = scale.transform(counter.transform(df))
            unit = Normalizer(p=2.0, inputCol="_scaled", outputCol=out)
            df = unit.transform(scaled).drop("_words", "_counts", "_scaled")
        return df


def _learned(vocab: DataFrame) -> tuple[list[str], list[float]]:
    """The vocabulary as model state; its size is bounded by the vectoriser's limit."""
    rows = vocab.select("term", "idf").orderBy("pos").collect()
    return [r["term"] for r in rows], [float(r["idf"]) for r in rows]


class TextTfidf(Estimator, HasInputCol, HasOutputCol, _VocabularyParams, _Stage):
    """TF-IDF vectors of one text column."""

    @keyword_only
    def __init__(
        self, *, inputCol=None, outputCol=None, maxFeatures=1000, minDF=1.0, maxDF=1.0,
        ngramMin=1, ngramMax=1, analyzer="plain",
    ):
        super().__init__()
        self._setDefault(maxFeatures=1000, minDF=1.0, maxDF=1.0, ngramMin=1, ngramMax=1, analyzer="plain")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> TextTfidfModel:
        texts = df.select(_text(df, self.getInputCol()).alias("text"), F.lit(1).alias("weight"))
        terms, idf = _learned(vocabulary(texts, self.spec()))
        return TextTfidfModel(
            inputCol=self.getInputCol(),
            outputCol=self.getOutputCol(),
            terms=terms,
            idf=idf,
            ngramMin=self.getOrDefault(self.ngramMin),
            ngramMax=self.getOrDefault(self.ngramMax),
            analyzer=self.getOrDefault(self.analyzer),
        )


class TextTfidfModel(Model, HasInputCol, HasOutputCol, _TermsParams, _Stage):
    @keyword_only
    def __init__(
        self, *, inputCol=None, outputCol=None, terms=None, idf=None, ngramMin=1, ngramMax=1, analyzer="plain"
    ):
        super().__init__()
        self._setDefault(ngramMin=1, ngramMax=1, analyzer="plain")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._unit_vectors(df, {self.getOutputCol(): _text(df, self.getInputCol())})


class SimilarityTfidf(Estimator, HasOutputCol, _VocabularyParams, _Stage):
    """Cosine of a row's candidate and job text under a vocabulary of both."""

    jobCol = _PairStage.jobCol
    candidateCol = _PairStage.candidateCol

    @keyword_only
    def __init__(
        self, *, jobCol=None, candidateCol=None, outputCol="sim_cv_vaga", maxFeatures=2000,
        minDF=3.0, maxDF=0.9, ngramMin=1, ngramMax=1, analyzer="no_stop_words",
    ):
        super().__init__()
        self._setDefault(
            outputCol="sim_cv_vaga", maxFeatures=2000, minDF=3.0, maxDF=0.9, ngramMin=1, ngramMax=1,
            analyzer="no_stop_words",
        )
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> SimilarityTfidfModel:
        job, candidate = self.getOrDefault(self.jobCol), self.getOrDefault(self.candidateCol)
        cvs = df.select(_text(df, candidate).alias("text"), F.lit(1).cast("bigint").alias("weight"))
        jobs = df.groupBy(_text(df, job).alias("text")).agg(F.count("*").alias("weight"))
        terms, idf = _learned(vocabulary(cvs.unionByName(jobs), self.spec()))
        return SimilarityTfidfModel(
            jobCol=job,
            candidateCol=candidate,
            outputCol=self.getOutputCol(),
            terms=terms,
            idf=idf,
            ngramMin=self.getOrDefault(self.ngramMin),
            ngramMax=self.getOrDefault(self.ngramMax),
            analyzer=self.getOrDefault(self.analyzer),
        )


class SimilarityTfidfModel(Model, HasOutputCol, _TermsParams, _Stage):
    jobCol = _PairStage.jobCol
    candidateCol = _PairStage.candidateCol

    @keyword_only
    def __init__(
        self, *, jobCol=None, candidateCol=None, outputCol="sim_cv_vaga", terms=None, idf=None,
        ngramMin=1, ngramMax=1, analyzer="no_stop_words",
    ):
        super().__init__()
        self._setDefault(outputCol="sim_cv_vaga", ngramMin=1, ngramMax=1, analyzer="no_stop_words")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        left, right = free_name(df, "cv_unit"), free_name(df, "job_unit")
        texts = {
            left: _text(df, self.getOrDefault(self.candidateCol)),
            right: _text(df, self.getOrDefault(self.jobCol)),
        }
        rows = self._unit_vectors(df, texts)
        if not self.getOrDefault(self.terms):
            return rows.withColumn(self.getOutputCol(), F.lit(0.0)).drop(left, right)

        def product(both: Column) -> Column:
            """Over the terms of the candidate alone, in their order."""
            cv, job = both["cv"], both["job"]
            each = F.zip_with(cv["indices"], cv["values"], lambda i, x: x * F.get(job, i))
            return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)

        sides = F.struct(F.unwrap_udt(left).alias("cv"), vector_to_array(right).alias("job"))
        cosine = let(sides, product)
        return rows.withColumn(self.getOutputCol(), cosine).drop(left, right)


def medians(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Exact median of each column's non-null values."""
    rows = quantiles(df, names, {"median": 0.5}).collect()
    return {r["feature"]: r["median"] for r in rows}


def impute_medians(df: DataFrame, names: Sequence[str], fitted: Mapping[str, float] | None = None) -> DataFrame:
    known = medians(df, names) if fitted is None else fitted
    return df.withColumns(
        {n: F.coalesce(known_number(col(n)), F.lit(known[n])) for n in names if n in known}
    )


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Most frequent non-null value of each column, the smallest on a tie."""
    texts = df.select(*[col(n).cast("string").alias(n) for n in names])
    counts = (
        texts.unpivot([], cols(names), "feature", "value")
        .filter("value is not null")
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"))
    )
    best = counts.groupBy("feature").agg(F.max("n").alias("n"))
    tops = counts.join(F.broadcast(best), ["feature", "n"]).groupBy("feature").agg(F.min("value").alias("mode"))
    return {r["feature"]: r["mode"] for r in tops.collect()}


def impute_modes(df: DataFrame, names: Sequence[str], fitted: Mapping[str, str] | None = None) -> DataFrame:
    known = modes(df, names) if fitted is None else fitted
    kinds = dict(df.dtypes)
    return df.withColumns(
        {n: F.coalesce(col(n), F.lit(known[n]).cast(kinds[n])) for n in names if n in known}
    )


def scaling(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; 1 for a constant one."""
    parts = [F.avg(known_number(col(n))).alias(f"m_{i}") for i, n in enumerate(names)]
    parts += [F.stddev_pop(known_number(col(n))).alias(f"s_{i}") for i, n in enumerate(names)]
    row = df.agg(*parts).first()
    return {n: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, n in enumerate(names)}


def standard_scale(
    df: DataFrame,
    names: Sequence[str],
    with_mean: bool = True,
    fitted: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    known = scaling(df, names) if fitted is None else fitted

    def scaled(name: str) -> Column:
        mean, deviation = known[name]
        return (known_number(col(name)) - F.lit(mean if with_mean else 0.0)) / F.lit(deviation)

    return df.withColumns({n: scaled(n) for n in names})


class CategoryPreparation(Estimator, HasInputCols, _Stage):
    """Learns the most frequent value of each column and fills missing ones with it."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._setDefault(inputCols=[])
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CategoryPreparationModel:
        names = self.getInputCols()
        found = modes(df, names)
        return CategoryPreparationModel(inputCols=names, fills=[found.get(n, "") for n in names])


class CategoryPreparationModel(Model, HasInputCols, _Stage):
    fills = Param(Params._dummy(), "fills", "value for missing entries", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, fills=None):
        super().__init__()
        self._setDefault(inputCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = zip(self.getInputCols(), self.getOrDefault(self.fills), strict=True)
        have = set(df.columns)
        return df.withColumns(
            {n: F.coalesce(col(n).cast("string") if n in have else F.lit(None), F.lit(v)) for n, v in fitted}
        )


class LinearScorer(Transformer, HasInputCols, HasOutputCol, _Stage):
    """Probability vector from given coefficients: a logistic model that was not fitted here."""

    weights = Param(Params._dummy(), "weights", "one coefficient per column", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "value without any input", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="probability", weights=None, intercept=0.0):
        super().__init__()
        self._setDefault(outputCol="probability", intercept=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        pairs = zip(self.getInputCols(), self.getOrDefault(self.weights), strict=True)
        margin = reduce(Column.__add__, [col(n) * w for n, w in pairs], F.lit(self.getOrDefault(self.intercept)))
        one = 1 / (1 + F.exp(-margin))
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(1 - one, one)))


class NumberPreparation(Estimator, HasInputCols, _Stage):
    """Learns medians for missing numbers and, if asked, population deviations to divide by."""

    scale = Param(Params._dummy(), "scale", "divide by the deviation", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols=None, scale=False):
        super().__init__()
        self._setDefault(inputCols=[], scale=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NumberPreparationModel:
        names = self.getInputCols()
        middle = medians(df, names)
        spread = scaling(impute_medians(df, names, middle), names) if self.getOrDefault(self.scale) else {}
        return NumberPreparationModel(
            inputCols=names,
            medians=[middle.get(n, 0.0) for n in names],
            divisors=[spread[n][1] if n in spread else 1.0 for n in names],
        )


class NumberPreparationModel(Model, HasInputCols, _Stage):
    medians = Param(Params._dummy(), "medians", "value for missing numbers", TypeConverters.toListFloat)
    divisors = Param(Params._dummy(), "divisors", "scale of each column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, medians=None, divisors=None):
        super().__init__()
        self._setDefault(inputCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = zip(
            self.getInputCols(), self.getOrDefault(self.medians), self.getOrDefault(self.divisors), strict=True
        )
        return df.withColumns(
            {n: F.coalesce(known_number(col(n)), F.lit(m)) / F.lit(d) for n, m, d in fitted}
        )
