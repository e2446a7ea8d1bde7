"""The twelve collections of the knowledge store: typed properties, index flags and references.

Fixed values: collection, property and reference names, with their types and flags.
  v   vectorized and searchable          s   stored and filterable only
  r   stored, with range filters         q   searchable, but not vectorized
Every collection also has the three properties of ``COMMON``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {
    "text": T.StringType(),
    "text[]": T.ArrayType(T.StringType()),
    "int": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.TimestampType(),
}

COMMON = "created_at date r, updated_at date r, source_tool text s"

COLLECTIONS = {
    "ResearchFindings": "topic text v, scope text s, claim text v, evidence_tier text s, reasoning text v, executive_summary text v, confidence number r, open_questions text[] q, supporting text[] v, contradicting text[] v, methodology_critique text v, recommendations text[] v, report_uuid text s",
    "VideoAnalyses": "video_id text s, source_url text s, instruction text v, title text v, summary text v, key_points text[] v, raw_result text s, timestamps_json text s, topics text[] v, sentiment text s, local_filepath text s, screenshot_dir text s",
    "ContentAnalyses": "source text s, instruction text v, title text v, summary text v, key_points text[] v, entities text[] v, raw_result text s, structure_notes text v, quality_assessment text v, local_filepath text s",
    "VideoMetadata": "video_id text s, title text v, description text v, channel_title text v, tags text[] v, view_count int r, like_count int r, duration text s, published_at text s, channel_id text s, comment_count int r, duration_seconds int r, category text v, definition text s, has_captions boolean s, default_language text s",
    "SessionTranscripts": "session_id text s, video_title text v, turn_index int r, turn_prompt text v, turn_response text v, local_filepath text s",
    "WebSearchResults": "query text v, response text v, sources_json text s",
    "ResearchPlans": "topic text v, scope text s, task_decomposition text[] v, phases_json text s, recommended_models_json text s",
    "CommunityReactions": "video_id text s, video_title text v, comment_count int r, sentiment_positive number r, sentiment_negative number r, sentiment_neutral number r, themes_positive text[] v, themes_critical text[] v, consensus text v, notable_opinions_json text s",
    "ConceptKnowledge": "concept_name text v, state text s, source_url text s, source_title text v, source_category text s, description text v, timestamp text s",
    "RelationshipEdges": "from_concept text v, to_concept text v, relationship_type text s, source_url text s, source_category text s",
    "CallNotes": "video_id text s, source_url text s, title text v, summary text v, participants text[] v, decisions text[] v, action_items text[] v, topics_discussed text[] v, duration text s, meeting_date text s, local_filepath text s",
    "DeepResearchReports": "interaction_id text s, topic text v, report_text text v, sources_json text s, source_count int r, status text s, duration_seconds int r, usage_json text s, follow_up_ids text[] s, follow_ups_json text s",
}

REFERENCES = [
    ("ResearchFindings", "belongs_to_report", "ResearchFindings"),
    ("VideoAnalyses", "has_metadata", "VideoMetadata"),
    ("CommunityReactions", "for_video", "VideoMetadata"),
    ("DeepResearchReports", "related_findings", "ResearchFindings"),
    ("DeepResearchReports", "related_web_searches", "WebSearchResults"),
]

#: The text that a second-stage ranker reads; collections that are missing here are never reranked.
RERANK_PROPERTY = {
    "ResearchFindings": "claim", "VideoAnalyses": "summary", "ContentAnalyses": "summary", "VideoMetadata": "description", "SessionTranscripts": "turn_response", "WebSearchResults": "response",
    "ResearchPlans": "topic", "CommunityReactions": "consensus", "ConceptKnowledge": "description", "RelationshipEdges": "relationship_type", "CallNotes": "summary",
}

EVIDENCE_TIERS = ["CONFIRMED", "STRONG INDICATOR", "INFERENCE", "SPECULATION", "UNKNOWN"]
RELATIONSHIP_TYPES = ["enables", "example_of", "builds_on", "contradicts", "related_to"]
KNOWLEDGE_STATES = ["know", "fuzzy", "unknown"]
#: Properties of a configuration that hold secrets.
SECRETS = ["gemini_api_key", "youtube_api_key", "weaviate_api_key", "infra_admin_token"]

EDGE_SCHEMA = "from_collection string, from_id string, ref_name string, to_collection string, to_id string"


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    flag: str

    @property
    def vectorized(self) -> bool:
        return self.flag == "v" and self.type.startswith("text")

    @property
    def searchable(self) -> bool:
        return self.flag in "vq" and self.type.startswith("text")

    @property
    def ranged(self) -> bool:
        return self.flag == "r"


def properties(collection: str) -> list[Property]:
    """All properties, the common ones first; an unknown type raises."""
    if collection not in COLLECTIONS:
        raise ValueError(f"unknown collection {collection!r}; there are {', '.join(COLLECTIONS)}")
    out = [Property(*p.split()) for p in f"{COMMON}, {COLLECTIONS[collection]}".split(", ")]
    for p in out:
        if p.type not in TYPES:
            raise ValueError(f"unknown type {p.type!r} of {collection}.{p.name}")
    return out


def struct(collection: str) -> T.StructType:
    """The collection's schema with ``object_id`` first; flags are in the fields' metadata."""
    fields = [T.StructField("object_id", T.StringType())]
    fields += [T.StructField(p.name, TYPES[p.type], True, {"vectorize": p.vectorized, "searchable": p.searchable, "range": p.ranged}) for p in properties(collection)]
    return T.StructType(fields)


def search_text(collection: str, vectorized: bool = False):
    """Column: the searchable (or vectorized) properties in the schema's order, joined by a space."""
    parts = [F.array_join(p.name, " ") if p.type == "text[]" else F.col(p.name) for p in properties(collection) if (p.vectorized if vectorized else p.searchable)]
    return F.concat_ws(" ", *parts)


def catalog(spark: SparkSession, collection: str | None = None) -> DataFrame:
    """collection, position, property, type, vectorized, searchable, ranged."""
    names = [collection] if collection else list(COLLECTIONS)
    rows = [(c, i, p.name, p.type, p.vectorized, p.searchable, p.ranged) for c in names for i, p in enumerate(properties(c))]
    return spark.createDataFrame(rows, "collection string, position int, property string, type string, vectorized boolean, searchable boolean, ranged boolean")
