"""Language of Latin text from character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.functions import text as X

# fixed values: language codes the profile maps to, by label index
LANGUAGES = ["en", "es", "fr", "de", "it", "pt", "ru", "zh", "ja", "ar", "ko", "hi"]


def language_profile(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """Trains on labelled rows and labels every row: (key, lang, predicted, script)."""
    code = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), F.col(lang)) - 1
    rows = df.select(key, lang, F.col(text).alias("_t"), code.cast("double").alias("_label"), X.char_ngram_array(text, 1, 3).alias("_grams"))
    tf = HashingTF(inputCol="_grams", outputCol="_vec", numFeatures=1 << 14)
    model = NaiveBayes(featuresCol="_vec", labelCol="_label", predictionCol="_pred").fit(
        tf.transform(rows.filter(F.col("_label") >= 0))
    )
    out = model.transform(tf.transform(rows))
    name = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("_pred").cast("int") + 1)
    script = X.script_language("_t")
    return out.select(key, lang, F.when(script == "en", name).otherwise(script).alias("predicted"), script.alias("script"))
