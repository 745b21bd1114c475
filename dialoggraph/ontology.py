"""The closed vocabulary of the dialogue graph and its dimension tables.

Everything under a "Fixed values" comment must equal the published vocabulary, because
results are compared on it.  Descriptions meant for prompts are our own wording.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lookup import lookup

# Node classes in display order, with whether a session may hold several,
# the property that carries the text, the id prefix and the display layer.
CLASSES = [
    # label, multi, text property, id prefix, layer
    ("Utterance", True, None, "utt", "provenance"),
    ("Client", False, None, "client", "session"),
    ("Session", False, None, "session", "session"),
    ("Problem", True, "description", "prob", "session_structure"),
    ("Goal", True, "statement", "goal", "session_structure"),
    ("Intervention", True, "description", "intv", "session_structure"),
    ("Homework", True, "taskDescription", "hw", "session_structure"),
    ("CoreBelief", True, "content", "cb", "cognitive"),
    ("IntermediateBelief", True, "content", "ib", "cognitive"),
    ("Situation", True, "description", "sit", "cognitive"),
    ("AutomaticThought", True, "content", "at", "cognitive"),
    ("Reaction", True, "content", "react", "cognitive"),
    ("AdaptiveResponse", True, "content", "adapt", "cognitive"),
]
LABELS = [c[0] for c in CLASSES]
SCAFFOLD_LABELS = ["Utterance", "Client", "Session"]
CONTENT_LABELS = [c for c in LABELS if c not in SCAFFOLD_LABELS]
TEXT_PROP = {c[0]: c[2] for c in CLASSES if c[2]}
ID_PREFIX = {c[0]: c[3] for c in CLASSES}
LAYER = {c[0]: c[4] for c in CLASSES}
# Where text is looked for when the class property is missing.
FALLBACK_TEXT_PROPS = ["description", "content", "statement", "taskDescription", "text"]

# Parent of every class.
PARENT = {
    "OWL_Thing": None,
    "Provenance": "OWL_Thing", "Utterance": "Provenance",
    "SessionStructure": "OWL_Thing", "Session": "SessionStructure", "Client": "OWL_Thing",
    "Problem": "SessionStructure", "Goal": "SessionStructure",
    "Intervention": "SessionStructure", "Homework": "SessionStructure",
    "CognitiveModel": "OWL_Thing",
    "CoreBelief": "CognitiveModel", "IntermediateBelief": "CognitiveModel",
    "Situation": "CognitiveModel", "AutomaticThought": "CognitiveModel",
    "Reaction": "CognitiveModel", "AdaptiveResponse": "CognitiveModel",
}

# Property types per class.
PROPS = {
    "Utterance": {"text": "string", "speaker": "enum", "turnIndex": "integer", "timestamp": "string"},
    "Client": {},
    "Session": {"sessionNumber": "integer", "sessionType": "enum", "date": "string", "duration": "string"},
    "Problem": {"description": "string", "domain": "enum"},
    "Goal": {"statement": "string"},
    "Intervention": {"description": "string", "technique": "enum", "techniqueLabel": "string"},
    "Homework": {"taskDescription": "string", "taskType": "enum", "isOptional": "boolean"},
    "CoreBelief": {"content": "string", "domain": "enum", "category": "enum"},
    "IntermediateBelief": {"content": "string", "subtype": "enum"},
    "Situation": {"description": "string", "context": "string", "kind": "enum", "temporality": "enum"},
    "AutomaticThought": {"content": "string", "modality": "enum", "distortionType": "enum"},
    "Reaction": {"content": "string", "channel": "enum", "valence": "enum"},
    "AdaptiveResponse": {"content": "string"},
}

# Enumerations.
PROBLEM_DOMAINS = ["academic", "work", "social", "family", "financial", "health", "other"]
BATCH_PROBLEM_DOMAINS = ["academic", "work", "social", "family", "financial", "health",
                         "personal", "other"]
ENUMS = {
    ("Utterance", "speaker"): ["therapist", "client"],
    ("Session", "sessionType"): ["evaluation", "therapy"],
    ("Problem", "domain"): PROBLEM_DOMAINS,
    ("CoreBelief", "domain"): ["self", "world", "others"],
    ("CoreBelief", "category"): ["helpless", "unlovable", "worthless"],
    ("IntermediateBelief", "subtype"): ["attitude", "rule", "assumption"],
    ("Reaction", "channel"): ["emotional", "behavioral", "physiological"],
    ("Reaction", "valence"): ["positive", "negative"],
    ("Situation", "kind"): ["externalSituation", "thoughtStream", "image", "emotion",
                            "behavior", "physiological"],
    ("Situation", "temporality"): ["past", "present", "anticipated"],
    ("AutomaticThought", "modality"): ["verbal", "image"],
    ("AutomaticThought", "distortionType"): [
        "allOrNothing", "catastrophizing", "discountingPositive", "fortuneTelling", "labeling",
        "mentalFiltering", "mindReading", "overgeneralization", "personalization",
        "shouldStatements", "none"],
    ("Intervention", "technique"): [
        "efficiencyEvaluation", "pieChartTechnique", "alternativePerspective",
        "decatastrophizing", "prosAndConsAnalysis", "evidenceBasedQuestioning",
        "realityTesting", "continuumTechnique", "changingRulesToWishes", "behaviorExperiment",
        "problemSolvingSkillsTraining", "systematicExposure", "other"],
    ("Homework", "taskType"): ["thoughtRecord", "behavioralExperiment", "activityScheduling",
                               "copingCard", "skillsPractice", "reading", "other"],
}
# The property that subdivides a class.
DISCRIMINATOR = {"Problem": "domain", "CoreBelief": "domain",
                 "IntermediateBelief": "subtype", "Reaction": "channel"}
# Property passes in order, discriminators first.
PROPERTY_PASSES = [
    ("Problem", "domain"), ("CoreBelief", "domain"), ("IntermediateBelief", "subtype"),
    ("Reaction", "channel"), ("AutomaticThought", "distortionType"),
    ("AutomaticThought", "modality"), ("Situation", "kind"), ("Intervention", "technique"),
    ("Homework", "taskType"), ("CoreBelief", "category"), ("Homework", "isOptional"),
]

# Relation families, subject -> predicate -> object, in order.
FAMILIES = [
    ("Situation", "triggers", "AutomaticThought"),
    ("Situation", "triggers", "Reaction"),
    ("AutomaticThought", "leadsTo", "Reaction"),
    ("AutomaticThought", "stemsFrom", "CoreBelief"),
    ("AutomaticThought", "stemsFrom", "IntermediateBelief"),
    ("AutomaticThought", "associatedWith", "Problem"),
    ("AutomaticThought", "hasAdaptiveResponse", "AdaptiveResponse"),
    ("CoreBelief", "givesRiseTo", "IntermediateBelief"),
    ("IntermediateBelief", "influencesPerceptionOf", "Situation"),
    ("Reaction", "becomesSituation", "Situation"),
    ("Reaction", "leadsTo", "Reaction"),
    ("Problem", "manifestsAs", "Situation"),
    ("Goal", "targetsProblem", "Problem"),
    ("Homework", "targets", "Problem"),
    ("Homework", "targets", "AutomaticThought"),
    ("Homework", "targets", "IntermediateBelief"),
    ("Homework", "targets", "CoreBelief"),
    ("Intervention", "appliedTo", "AutomaticThought"),
    ("Intervention", "appliedTo", "IntermediateBelief"),
    ("Intervention", "appliedTo", "CoreBelief"),
    ("Intervention", "appliedTo", "Problem"),
    ("Intervention", "produces", "AdaptiveResponse"),
]
REINFORCES = ("Reaction", "reinforces", "CoreBelief")
SIGNATURES = FAMILIES + [REINFORCES]
# Structure and provenance.
STRUCTURE = [
    ("Client", "hasSession", "Session"), ("Session", "hasProblem", "Problem"),
    ("Session", "hasIntervention", "Intervention"), ("Session", "hasHomework", "Homework"),
]
EDGE_MAP = (SIGNATURES + STRUCTURE
            + [(c, "evidencedBy", "Utterance") for c in CONTENT_LABELS]
            + [("Utterance", "inSession", "Session")])
PREDICATES = list(dict.fromkeys(p for _, p, _ in EDGE_MAP))
STRUCTURAL_PREDICATES = ["hasSession", "hasProblem", "hasIntervention", "hasHomework",
                         "evidencedBy", "inSession"]
# Subject, predicate ("*" = any), object that must not occur.
DISJOINT = [
    ("AutomaticThought", "*", "AutomaticThought"),
    ("CoreBelief", "influencesPerceptionOf", "Situation"),
    ("Intervention", "appliedTo", "Goal"),
]

# Speaker spellings, and which classes a speaker tends to voice.
SPEAKERS = {"client": "client", "patient": "client", "therapist": "therapist"}
SPEAKER_PRIOR = {
    "client": ["Situation", "AutomaticThought", "Reaction", "CoreBelief", "IntermediateBelief",
               "Problem", "Goal", "AdaptiveResponse"],
    "therapist": ["Intervention", "Homework", "Goal", "AdaptiveResponse"],
}
# Classes of the whole-session pass and the classes that ground them.
SESSION_PASS_CLASSES = ["CoreBelief", "IntermediateBelief", "Problem", "Goal", "Intervention",
                        "Homework", "AdaptiveResponse"]
ADJACENT = {
    "CoreBelief": ["AutomaticThought"],
    "IntermediateBelief": ["CoreBelief", "AutomaticThought"],
    "Problem": ["Situation", "Reaction"],
    "Goal": ["Problem"],
    "Intervention": ["AutomaticThought", "IntermediateBelief", "CoreBelief"],
    "Homework": ["Problem", "AutomaticThought", "IntermediateBelief"],
    "AdaptiveResponse": ["AutomaticThought", "Intervention"],
    "Reaction": ["AutomaticThought", "Situation"],
}
ATOMISE_CLASSES = ["AutomaticThought", "CoreBelief", "IntermediateBelief"]
NORMALISE_CLASSES = ["Intervention", "Homework"]
RECLASSIFY_TARGETS = ["CoreBelief", "IntermediateBelief", "AutomaticThought"]
CHAIN_PREDICATES = ["triggers", "leadsTo", "stemsFrom"]

# Phases, what each requires and the earliest turn.
PHASES = ["Rapport", "Exploration", "Technique", "Consolidation"]
PHASE_REQUIRES = {"Exploration": ["Problem"], "Technique": ["AutomaticThought", "Situation"],
                  "Consolidation": ["AdaptiveResponse"]}
PHASE_MIN_TURN = {"Exploration": 2, "Technique": 5, "Consolidation": 12}
INITIAL_TECHNIQUE = "Rapport Building"
CONSOLIDATE_EVERY = 6

# Time markers, first match in this order wins; Thai is case-sensitive.
TIME_MARKERS_TH = {
    "เมื่อวาน": "past", "เมื่อกี้": "past", "ที่แล้ว": "past", "ก่อนหน้านี้": "past",
    "ตอนเด็ก": "past", "สมัยก่อน": "past", "เคย": "past", "ที่ผ่านมา": "past",
    "ตอนนี้": "present", "ขณะนี้": "present", "ช่วงนี้": "present", "ทุกวันนี้": "present",
    "พรุ่งนี้": "anticipated", "เดือนหน้า": "anticipated", "ปีหน้า": "anticipated",
    "กำลังจะ": "anticipated", "ในอนาคต": "anticipated", "ต่อไป": "anticipated",
}
TIME_MARKERS_EN = {
    "yesterday": "past", "last week": "past", "as a child": "past", "used to": "past",
    "right now": "present", "these days": "present", "currently": "present",
    "tomorrow": "anticipated", "next week": "anticipated", "next month": "anticipated",
    "going to": "anticipated", "in the future": "anticipated",
}
# Emotion words.
NEGATIVE_TH = ["เศร้า", "เหงา", "เสียใจ", "กลัว", "กังวล", "เครียด", "โกรธ", "ผิดหวัง", "อาย",
               "ท้อ", "หดหู่", "สิ้นหวัง", "เจ็บปวด", "ว้าวุ่น"]
POSITIVE_TH = ["ดีใจ", "สบายใจ", "โล่งใจ", "มีความสุข", "ภูมิใจ", "อุ่นใจ", "มั่นใจ", "ผ่อนคลาย"]
NEGATIVE_EN = ["sad", "lonely", "anxious", "afraid", "scared", "worried", "angry", "ashamed",
               "hopeless", "depressed", "devastated", "heartbroken", "guilty"]
POSITIVE_EN = ["happy", "relieved", "proud", "calm", "confident", "glad", "content"]


def relation_type(predicate: str) -> str:
    """camelCase predicate -> UPPER_SNAKE relation type used by the property-graph tables."""
    return "".join("_" + ch if ch.isupper() else ch.upper() for ch in predicate)


REL_TYPE = {p: relation_type(p) for p in PREDICATES}

# Short glosses shown to a model next to a class; our own wording.
CLASS_GLOSS = {
    "Problem": "a lasting area of difficulty that could head an agenda",
    "Goal": "an outcome the client wants to reach",
    "Intervention": "a technique the therapist carries out",
    "Homework": "a task set for the time until the next session",
    "CoreBelief": "an unconditional belief about self, world or others",
    "IntermediateBelief": "a rule, assumption or attitude",
    "Situation": "one concrete moment that set off a thought",
    "AutomaticThought": "a spontaneous thought tied to one moment",
    "Reaction": "a feeling, act or body sensation that followed",
    "AdaptiveResponse": "a balanced answer to an automatic thought",
}


@dataclass(frozen=True)
class Ontology:
    """Vocabulary of one version plus its dimension DataFrames.

    ``live`` is the authoritative version; ``batch`` keeps the few points in which the
    transcript pipeline differs.
    """

    version: str = "live"
    enums: dict = field(default_factory=dict)
    families: tuple = ()
    text_prop: dict = field(default_factory=dict)
    id_prefix: dict = field(default_factory=dict)

    @staticmethod
    def of(version: str = "live") -> "Ontology":
        if version == "live":
            return Ontology(version, dict(ENUMS), tuple(FAMILIES), dict(TEXT_PROP), dict(ID_PREFIX))
        if version == "batch":
            enums = dict(ENUMS)
            enums[("Problem", "domain")] = BATCH_PROBLEM_DOMAINS
            families = tuple(f for f in FAMILIES
                             if f != ("AutomaticThought", "stemsFrom", "IntermediateBelief"))
            prefixes = {k: v for k, v in ID_PREFIX.items() if k != "Utterance"}
            return Ontology(version, enums, families,
                            {**TEXT_PROP, "Intervention": "techniqueLabel"}, prefixes)
        raise ValueError(f"unknown ontology version {version!r}")

    def classes(self, spark: SparkSession) -> DataFrame:
        rows = [(i, l, PARENT[l], m, self.text_prop.get(l), self.id_prefix.get(l), layer)
                for i, (l, m, _, _, layer) in enumerate(CLASSES)]
        return spark.createDataFrame(
            rows, "class_ord int, label string, parent string, multi boolean, "
                  "text_prop string, id_prefix string, layer string")

    def hierarchy(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(PARENT.items()), "label string, parent string")

    def ancestry(self, spark: SparkSession) -> DataFrame:
        """Transitive closure (class, ancestor, depth), the class itself at depth 0."""
        rows = []
        for label in PARENT:
            up, depth = label, 0
            while up is not None:
                rows.append((label, up, depth))
                up, depth = PARENT[up], depth + 1
        return spark.createDataFrame(rows, "label string, ancestor string, depth int")

    def properties(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(l, p, t) for l, ps in PROPS.items() for p, t in ps.items()],
            "label string, prop string, type string")

    def enum_values(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(l, p, i, v) for (l, p), vs in self.enums.items() for i, v in enumerate(vs)],
            "label string, prop string, value_ord int, value string")

    def family_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, s, p, o) for i, (s, p, o) in enumerate(self.families)],
            "family_ord int, subject_label string, predicate string, object_label string")

    def signatures(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(self.families) + [REINFORCES] ,
            "subject_label string, predicate string, object_label string")

    def edge_map(self, spark: SparkSession) -> DataFrame:
        rows = [e for e in EDGE_MAP
                if e in self.families or e == REINFORCES or e not in FAMILIES]
        return spark.createDataFrame(
            [(i, *e) for i, e in enumerate(rows)],
            "map_ord int, subject_label string, predicate string, object_label string")

    def relations(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(REL_TYPE.items()), "predicate string, rel_type string")

    def adjacent(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(l, i, p) for l, ps in ADJACENT.items() for i, p in enumerate(ps)],
            "label string, prior_ord int, prior_label string")

    def render(self) -> str:
        """Compact text form of the content classes, for prompts."""
        lines = []
        for label in CONTENT_LABELS:
            shown = []
            for prop, kind in PROPS[label].items():
                values = self.enums.get((label, prop))
                shown.append(f"{prop}=" + (" | ".join(values) if values else kind))
            lines.append(f"- {label}: " + "; ".join(shown))
        return "\n".join(lines)


def label_rank(col: str = "label"):
    """Position of a class in display order, as a column."""
    return lookup({l: i for i, l in enumerate(LABELS)}, F.col(col))
