"""Learned quality: hashed word counts and a linear model, trained and applied in the JVM."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the hashed counts.
CELLS = 1 << 12


def train_quality(rows: DataFrame, text_col: str = "text", label_col: str = "label") -> PipelineModel:
    """Fit on all rows that have a label; nothing is collected but the model."""
    data = rows.select(F.coalesce(text_col, F.lit("")).alias("_text"), F.col(label_col).cast("double").alias("_label")).where("_label IS NOT NULL")
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=CELLS, binary=True)
    model = LogisticRegression(featuresCol="_counts", labelCol="_label", maxIter=20, regParam=0.01)
    return Pipeline(stages=[words, counts, model]).fit(data)


def apply_quality(model: PipelineModel, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The probability of the label 1 for each row."""
    data = rows.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text"))
    return model.transform(data).select(id_col, F.round(F.get(vector_to_array("probability"), 1), 6).alias("probability"))
