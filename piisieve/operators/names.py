"""Person names from a user-supplied entity predictor.

Chunking, joining of touching entities, offsets, de-duplication and contexts are column expressions on
the document's own row: no shuffle, and the text never leaves the row. Only the predictor runs in Python.
"""

import logging
import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import first_per_key, let
from ..functions.matches import context_window, location_label
from ..functions.validators import is_not_blank
from .detector import Detector, finding_fields, no_findings

log = logging.getLogger(__name__)

# Chunk length and overlap in characters, context window, and the group that is a name.
CHUNK_LENGTH = 500
CHUNK_OVERLAP = 50
CHUNK_STEP = CHUNK_LENGTH - CHUNK_OVERLAP
NAME_WINDOW = 50
PERSON = "PERSON"
SCORE_DIGITS = 4

ENTITY_TYPE = pa.struct(
    [
        ("entity_group", pa.string()),
        ("word", pa.string()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("score", pa.float64()),
    ]
)
ENTITIES_DDL = (
    "array<array<struct<entity_group:string,word:string,start:int,end:int,score:double>>>"
)


def chunk_text(text: Column) -> Column:
    """Overlapping chunks of the whole text: 500 characters every 450.

    Each match takes one step and looks ahead for its chunk, so the text is read once however long it
    is. (Lambda functions are left out on purpose: the optimizer fails to move a Python function out of
    a projection when its input has nested ones.)
    """
    chunks = F.regexp_extract_all(
        text, F.lit(rf"(?s)(?=(.{{1,{CHUNK_LENGTH}}})).{{1,{CHUNK_STEP}}}"), F.lit(1)
    )
    return F.when(F.length(text) <= CHUNK_LENGTH, F.array(text)).otherwise(chunks)


def clean_entities(entities: Column) -> Column:
    """Drop word-piece marks and spaces from the words, and entities with nothing left."""
    cleaned = F.transform(
        entities,
        lambda e: e.withField(
            "word", F.replace(F.replace(e["word"], F.lit("##"), F.lit("")), F.lit(" "), F.lit(""))
        ),
    )
    return F.filter(cleaned, lambda e: e["word"] != "")


def merge_touching(entities: Column) -> Column:
    """Join neighbours of one group where the next starts at the end of the one before.

    The joined entity has all the words, the first start, the last end and the highest score. The array
    is one chunk's entities, so it is bounded by the chunk's length.
    """

    def step(runs: Column, e: Column) -> Column:
        def extend(last: Column) -> Column:
            touching = last["entity_group"].eqNullSafe(e["entity_group"]) & last["end"].eqNullSafe(
                e["start"]
            )
            joined = F.struct(
                last["entity_group"].alias("entity_group"),
                F.concat(last["word"], e["word"]).alias("word"),
                last["start"].alias("start"),
                e["end"].alias("end"),
                F.greatest(last["score"], e["score"]).alias("score"),
            )
            return F.when(
                touching, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(joined))
            ).otherwise(F.concat(runs, F.array(e)))

        return F.when(F.size(runs) == 0, F.array(e)).otherwise(let(F.element_at(runs, -1), extend))

    return F.aggregate(entities, F.slice(entities, 1, 0), step)


def locate_entities(chunks: Column, group: str = PERSON) -> Column:
    """One document's entities of a group with document offsets, each word and place once.

    `chunks` holds the entity array of each chunk. Of copies found in overlapping chunks the one from
    the earliest chunk stays.
    """

    def in_chunk(entities: Column, chunk: Column) -> Column:
        runs = F.filter(
            merge_touching(clean_entities(entities)), lambda e: e["entity_group"] == group
        )
        return F.transform(
            runs,
            lambda e, i: F.struct(
                (e["start"] + CHUNK_STEP * chunk).alias("start"),
                e["word"].alias("word"),
                chunk.alias("chunk"),
                i.alias("idx"),
                e["score"].alias("score"),
            ),
        )

    placed = F.array_sort(F.flatten(F.transform(chunks, in_chunk)))
    return first_per_key(placed, lambda e: F.struct(e["start"], e["word"]))


@dataclass(frozen=True)
class NameDetector(Detector):
    """Names found by `predictor_factory()(chunks)`; loaded once per Python worker, called once per document.

    The predictor takes a list of chunks and returns a list with one list of entities per chunk; an
    entity is a mapping with entity_group, word, start, end and score. If it raises, the document has
    no names.
    """

    name: str = "NlpNameScanner"
    pii_type: str = "PERSON_NAME"
    predictor_factory: Callable[[], Callable[[Sequence[str]], Sequence]] | None = None
    # Tells this detector's predictor from another's of the same name in a worker.
    key: str = field(default_factory=lambda: uuid.uuid4().hex, repr=False, compare=False)

    def __post_init__(self) -> None:
        super().__post_init__()
        if not callable(self.predictor_factory):
            raise TypeError(f"{self.name} needs a predictor factory")

    def candidates(self, text: Column) -> Column:
        name, key, factory = self.name, self.key, self.predictor_factory

        @F.arrow_udf(ENTITIES_DDL)
        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            predictor = _predictor(name, key, factory)
            for batch in batches:
                yield pa.array(
                    [None if chunks is None else _predict(predictor, chunks) for chunks in batch.to_pylist()],
                    type=pa.list_(pa.list_(ENTITY_TYPE)),
                )

        return predict(F.when(is_not_blank(text), chunk_text(text)))

    def findings(
        self, text: Column, candidates: Column, starts: Column | None, blocks: Column
    ) -> Column:
        def row(e: Column) -> Column:
            return F.struct(
                *finding_fields(
                    F.lit(self.pii_type),
                    e["word"],
                    e["score"],
                    F.lit(self.name),
                    F.lit("NOT_APPLICABLE"),
                    context_window(text, e["start"], F.length(e["word"]), NAME_WINDOW, blocks),
                    location_label(e["start"]),
                    e["start"],
                )
            )

        rows = let(
            locate_entities(candidates),
            lambda entities: F.when(
                # One score outside 0 to 1 voids this detector's findings for the document.
                F.forall(entities, lambda e: e["score"].between(0.0, 1.0)),
                F.transform(entities, row),
            ).otherwise(no_findings()),
        )
        return F.when(F.size(candidates) > 0, rows).otherwise(no_findings())


def _predictor(name: str, key: str, factory: Callable) -> Callable:
    """The worker's predictor for detectors of this name, loaded anew only for another detector.

    The code may be sent to the workers by value, which gives each task its own module globals, so it
    is kept in a module of its own in `sys.modules`.
    """
    holder = sys.modules.setdefault("piisieve_predictors", types.ModuleType("piisieve_predictors"))
    loaded = holder.__dict__.setdefault("loaded", {})
    if name not in loaded or loaded[name][0] != key:
        loaded.pop(name, None)
        loaded[name] = key, factory()
    return loaded[name][1]


def _predict(predictor: Callable, chunks: list[str]) -> list[list[dict]]:
    """One call for the document; rounding is done here because it works on the exact binary value."""
    try:
        results = predictor(chunks)
        return [
            [
                {
                    "entity_group": e.get("entity_group"),
                    "word": e["word"],
                    "start": int(e["start"]),
                    "end": int(e["end"]),
                    "score": round(float(e["score"]), SCORE_DIGITS),
                }
                for e in result
            ]
            if isinstance(result, list)
            else []
            for result in results
        ]
    except Exception:
        log.exception("the name predictor failed on a document")
        return []
