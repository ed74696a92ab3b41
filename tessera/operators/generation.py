"""Generation as a stage: a backend for each partition, and a stub that needs no model."""

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from tessera.functions.text import extract_answer


class Backend(Protocol):
    """What a generation engine offers; one object a partition."""

    def load(self) -> None: ...

    def generate(self, prompts: list[str]) -> list[str]: ...

    def close(self) -> None: ...


class Stub:
    """Answers each prompt with a query made of its last word; the same for the same prompt."""

    def load(self) -> None:
        self.ready = True

    def generate(self, prompts: list[str]) -> list[str]:
        return [f"Sure.\n\nMATCH (n) RETURN n.{(p.split() or ['x'])[-1].strip(':').lower()};" for p in prompts]

    def close(self) -> None:
        self.ready = False


BACKENDS = {"stub": Stub}


def generate(prompts: DataFrame, backend: str = "stub", prompt: str = "prompt", batch: int = 8, retries: int = 2) -> DataFrame:
    """Adds predicted_raw and predicted_cypher. Prompts go to the backend by length, so that a batch has little padding; a batch that
    fails after all tries gives empty outputs."""
    make = BACKENDS[backend]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        engine.load()
        try:
            for pdf in frames:
                texts = pdf[prompt].fillna("").tolist()
                order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
                out = [""] * len(texts)
                for a in range(0, len(order), batch):
                    part = order[a : a + batch]
                    for attempt in range(retries + 1):
                        try:
                            for k, text in zip(part, engine.generate([texts[k] for k in part]), strict=True):
                                out[k] = text
                            break
                        except Exception:
                            if attempt == retries:
                                break
                yield pdf.assign(predicted_raw=out)
        finally:
            engine.close()

    got = prompts.mapInPandas(run, f"{fields}, predicted_raw string")
    return got.withColumn("predicted_cypher", extract_answer(got["predicted_raw"]))
