"""Engine settings as one frozen value; every field can be set from the environment as ONTOLOOM_<FIELD>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConf:
    chunk_size: int = 2500
    chunk_overlap: int = 200
    batch_chunks: int = 3
    similarity: float = 0.85
    stable_from: float = 0.7
    validation_rounds: int = 3
    requests_per_minute: int = 8
    requests_per_day: int = 18
    min_gap_s: float = 3.0
    window_s: int = 60
    safety_s: int = 1

    @classmethod
    def from_env(cls) -> EngineConf:
        """Defaults, overridden by the environment; a value of the wrong type raises ValueError."""
        given = {f.name: os.environ.get(f"ONTOLOOM_{f.name.upper()}") for f in fields(cls)}
        return cls(**{f.name: type(f.default)(given[f.name]) for f in fields(cls) if given[f.name] is not None})


# Fixed values of the ontology model.
XSD_INGEST = ("xsd:string", "xsd:integer", "xsd:float", "xsd:double", "xsd:decimal", "xsd:boolean", "xsd:date", "xsd:dateTime")
XSD_VALID = (*XSD_INGEST, "xsd:int", "xsd:long", "xsd:nonNegativeInteger")
SPECIAL_CLASSES = ("owl:Thing", "rdfs:Literal", "ex:Thing")
KEPT_PREFIXES = ("ex", "xsd", "rdfs", "owl", "bfo")
TURTLE_PREFIXES = {
    "ex": "http://example.org/ontology#",
    "bfo": "http://purl.obolibrary.org/obo/BFO_",
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
