"""The registry of models that a table can be matched with."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    name: str
    kind: str
    modality: str
    task: str
    headers: tuple[str, ...] = ()
    output: str | None = None
    caption: str | None = None


#: Fixed values.
MODELS = (
    Model(
        "MODEL_01", "table", "anxiety prediction (palliative care)", "classification",
        ("age", "gender", "ECOG", "living_situation", "pal_care_service", "brain_metastases", "pain", "nausea", "vomiting", "dyspnea", "constipation", "weakness", "loss_appetite", "tiredness", "assistance_adl", "antidepressants", "sedatives_anxiolytics", "corticosteroids", "feeling_depressed", "tension", "disorientation_confusion"),
        "anxiety",
    ),
    Model("MODEL_02", "table", "hope prediction (palliative care)", "classification", ("age", "gender", "antidepressants", "vomiting", "pain", "assistance_adl", "loss_appetite", "feeling_depressed"), "hope_level"),
    Model("MODEL_03", "table", "fall prediction (geriatrics / GSTRIDE)", "classification", ("age", "sex", "bmi", "stride_length", "stride_time", "walking_speed", "foot_clearance", "foot_angle", "sppb", "tug", "grip_strength", "gds"), "faller"),
    Model("MODEL_06", "image", "colon colonoscopy scan", "detection", caption="Detects and classifies hyperplastic vs. adenomatous polyps in colonoscopy images."),
    Model("MODEL_07", "image", "breast histopathology scan", "classification", caption="Classify benign vs. malignant findings in breast histopathology slides."),
    Model("MODEL_09", "image", "colon colonoscopy scan", "detection", caption="Detects and localizes lesions in colonoscopy images."),
)


class Registry:
    def __init__(self, models: Sequence[Model] = MODELS) -> None:
        self.models = list(models)

    def register(self, model: Model) -> None:
        """Adds a model, or replaces the one of its name."""
        self.models = [m for m in self.models if m.name != model.name] + [model]

    def tables(self) -> list[Model]:
        return [m for m in self.models if m.kind == "table"]

    def images(self) -> list[Model]:
        return [m for m in self.models if m.kind == "image"]

    def modalities(self) -> list[str]:
        """Of the image models, distinct and sorted."""
        return sorted({m.modality for m in self.images()})

    def frame(self, spark: SparkSession) -> DataFrame:
        """(model, kind, modality, headers, output, caption, task, ord)."""
        rows = [(m.name, m.kind, m.modality, list(m.headers), m.output, m.caption, m.task, k) for k, m in enumerate(self.models)]
        return spark.createDataFrame(rows, "model string, kind string, modality string, headers array<string>, output string, caption string, task string, ord int")


def image_matches(registry: DataFrame, modalities: DataFrame) -> DataFrame:
    """(modality, model): the first image model by name of each modality, null where there is none."""
    images = registry.where("kind = 'image'").groupBy("modality").agg(F.min("model").alias("model"))
    return modalities.select("modality").distinct().join(images, "modality", "left")
