"""Configuration objects.  Every operator takes one of these as an argument.

The dictionaries, thresholds and weights below are fixed values: results only agree with the
published ones if they are equal.  They are small (each well under 200 entries), so they are
compiled into the plan as literals; nothing here grows with the data.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# --- fixed values: skill taxonomy -----------------------------------------------------------
CORE_SKILLS: tuple[str, ...] = (
    # foundations
    "Python", "Machine Learning", "Deep Learning", "Statistics", "Mathematics",
    "Statistical Modeling", "Data Science", "Feature Engineering", "A/B Testing",
    # language models
    "NLP", "LLMs", "Fine-tuning LLMs", "Transformers", "Hugging Face", "HuggingFace",
    "LoRA", "QLoRA", "PEFT", "Prompt Engineering", "LangChain", "LlamaIndex", "OpenAI API", "RAG",
    # vision and audio
    "Computer Vision", "Image Classification", "Object Detection", "GANs", "Diffusion Models",
    "Speech Recognition", "TTS",
    # frameworks
    "PyTorch", "TensorFlow", "Scikit-learn", "Keras", "JAX",
    # operations
    "MLOps", "Model Deployment", "ONNX", "DVC", "MLFlow", "Kubeflow",
    "Weights & Biases", "BentoML", "TorchServe", "Triton", "FastAPI",
    # retrieval
    "Vector Databases", "Milvus", "Pinecone", "Weaviate", "FAISS", "Qdrant", "pgvector",
    "Elasticsearch", "OpenSearch", "Solr", "Lucene", "BM25", "Hybrid Search",
    # ranking
    "Reinforcement Learning", "Learning to Rank", "LambdaMART", "XGBoost Ranker",
    "Recommender Systems",
)

# The dataset profile uses a shorter list of core skills than the scorer.
PROFILE_CORE_SKILLS: tuple[str, ...] = (
    "Python", "Machine Learning", "Deep Learning", "NLP", "LLMs", "Fine-tuning LLMs",
    "PyTorch", "TensorFlow", "Transformers", "RAG", "Vector Databases", "MLOps", "Hugging Face",
    "Computer Vision", "Reinforcement Learning", "Prompt Engineering", "LangChain", "OpenAI API",
    "Data Science", "Statistics", "Scikit-learn", "Model Deployment", "ONNX", "LoRA",
    "Milvus", "Pinecone", "Weaviate", "FAISS", "GANs", "Diffusion Models", "Speech Recognition",
    "Image Classification", "Object Detection", "Weights & Biases", "DVC", "Feature Engineering",
    "Statistical Modeling", "A/B Testing",
)

PROFICIENCY_WEIGHTS: dict[str, float] = {
    "expert": 4.0, "advanced": 3.0, "intermediate": 2.0, "beginner": 1.0,
}

EVIDENCE_KEYWORDS: dict[str, tuple[str, ...]] = {
    "retrieval": ("retrieval", "search", "bm25", "semantic search", "vector search",
                  "dense retrieval", "information retrieval"),
    "ranking": ("ranking", "rank", "learning to rank", "ltr", "ndcg", "re-ranking", "rerank"),
    "recommendation": ("recommendation", "recommender", "collaborative filtering",
                       "personalization"),
    "search": ("search engine", "elasticsearch", "solr", "lucene"),
    "relevance": ("relevance", "relevant", "query understanding"),
    "personalization": ("personalization", "personalized", "user behavior"),
    "evaluation": ("evaluation", "a/b testing", "offline evaluation", "metrics", "ndcg", "mrr",
                   "precision@k"),
    "machine_learning": ("machine learning", "ml", "deep learning", "dl", "predictive modeling"),
    "nlp": ("nlp", "natural language processing", "text mining", "llm", "large language model"),
    "production_ml": ("production", "scale", "latency", "throughput", "mlops", "deployment",
                      "serving", "high performance"),
}

CAPABILITY_GROUPS: dict[str, tuple[str, ...]] = {
    "retrieval": ("bm25", "elasticsearch", "opensearch", "solr", "lucene", "retrieval",
                  "information retrieval"),
    "dense_retrieval": ("faiss", "pinecone", "weaviate", "milvus", "pgvector", "qdrant", "annoy",
                        "hnsw", "approximate nearest neighbor"),
    "embeddings": ("sentence transformers", "bge", "e5", "minilm", "mpnet", "word2vec",
                   "bert embeddings", "embeddings"),
    "ranking": ("learning to rank", "lambdamart", "xgboost ranker", "ranknet",
                "pairwise ranking", "listwise ranking", "reranking", "re-ranking"),
    "llm_engineering": ("lora", "qlora", "peft", "huggingface", "transformers", "fine-tuning",
                        "prompt engineering", "llm"),
    "serving": ("bentoml", "torchserve", "triton", "fastapi", "flask", "model serving",
                "inference"),
    "evaluation": ("ndcg", "recall@k", "mrr", "precision@k", "offline evaluation",
                   "online evaluation", "a/b testing"),
    "recommendation_systems": ("collaborative filtering", "matrix factorization", "two-tower",
                               "deepfm", "recommendation", "recommender"),
    "hybrid_search": ("hybrid search", "reciprocal rank fusion", "rrf", "hybrid retrieval"),
    "rag": ("rag", "retrieval augmented generation", "langchain", "llamaindex"),
}

PIPELINE_STAGES: tuple[str, ...] = (
    "embeddings", "dense_retrieval", "hybrid_search", "ranking", "evaluation",
)

PRODUCTION_KEYWORDS: dict[str, tuple[str, ...]] = {
    "deployment": ("deploy", "deployment", "production", "kubernetes", "docker", "mlops",
                   "ci/cd", "airflow", "kubeflow", "sagemaker"),
    "monitoring": ("monitor", "monitoring", "drift", "mlflow", "prometheus", "grafana",
                   "drift detection", "data drift", "alerting"),
    "scaling": ("scale", "scaling", "high throughput", "distributed", "spark", "ray", "sharding",
                "replication"),
    "latency": ("latency", "microsecond", "millisecond", "onnx", "tensorrt", "quantization",
                "quantize", "throughput optimization"),
}

QUALITY_KEYWORDS: dict[str, tuple[str, ...]] = {
    "ownership": ("owned", "architected", "designed", "led", "built", "production ownership",
                  "end-to-end", "spearheaded"),
    "scale": ("millions of users", "scale", "high-throughput", "large-scale", "petabyte",
              "terabyte", "10m+", "100m+", "rps"),
    "leadership": ("mentored", "led", "tech lead", "principal", "staff", "manager", "guidance",
                   "supervise", "supervised"),
    "impact": ("improved by", "increased", "reduced latency", "optimized",
               "optimization impact", "kpi", "saved", "accelerated"),
}

# Tools named in an explanation, in display order: matched text -> shown text.
DISPLAY_TOOLS: dict[str, str] = {
    "elasticsearch": "Elasticsearch", "opensearch": "OpenSearch", "bm25": "BM25",
    "faiss": "FAISS", "pinecone": "Pinecone", "weaviate": "Weaviate", "milvus": "Milvus",
    "qdrant": "Qdrant", "pgvector": "pgvector", "lambdamart": "LambdaMART",
    "xgboost": "XGBoost", "langchain": "LangChain", "llamaindex": "LlamaIndex", "rag": "RAG",
    "lora": "LoRA", "peft": "PEFT",
}

# Title words -> archetype; the first row that matches decides.
ARCHETYPES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("search", "retrieval"), "Search Engineer"),
    (("recommendation", "recommender"), "Recommendation Engineer"),
    (("nlp", "language", "llm"), "NLP Engineer"),
    (("research", "scientist"), "AI Research Engineer"),
    (("vision", "cv "), "Computer Vision Engineer"),
    (("applied",), "Applied ML Engineer"),
    (("data",), "Data Scientist"),
)
ARCHETYPE_DEFAULT = "ML Engineer / General AI"

# --- fixed values: enumerations -------------------------------------------------------------
PROFICIENCIES = ("beginner", "intermediate", "advanced", "expert")
COMPANY_SIZES = ("1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000",
                 "10001+")
WORK_MODES = ("remote", "hybrid", "onsite", "flexible")
EDUCATION_TIERS = ("tier_1", "tier_2", "tier_3", "tier_4", "unknown")
RANKED_COLUMNS = ("candidate_id", "rank", "score", "reasoning")
ID_PATTERN = r"^CAND_[0-9]{7}$"
REFERENCE_DATE = "2026-06-23"
# --- fixed values: the defaults of the classes below, to the end of the file ------------------


@dataclass(frozen=True)
class RuleConfig:
    """Thresholds of the rule engine."""

    id_pattern: str = ID_PATTERN
    reference_date: str = REFERENCE_DATE
    max_years: float = 50.0
    max_notice_days: int = 180
    max_education_years: int = 12
    last_education_year: int = 2030
    inflated_years: float = 3.0
    skill_grace_months: int = 12
    overlap_grace_months: float = 3.0
    min_expert_endorsements: int = 1
    high_assessment: float = 85.0
    ghost_applications: int = 5
    complete_profile: float = 90.0
    sparse_skills: int = 3
    penalty_per_flag: float = 0.12
    min_trust: float = 0.25


@dataclass(frozen=True)
class Taxonomy:
    """Dictionaries read by the feature operators."""

    core_skills: tuple[str, ...] = CORE_SKILLS
    proficiency_weights: Mapping[str, float] = field(
        default_factory=lambda: dict(PROFICIENCY_WEIGHTS))
    default_proficiency_weight: float = 1.0
    endorsement_cap: int = 50
    evidence: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(EVIDENCE_KEYWORDS))
    capability: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(CAPABILITY_GROUPS))
    stages: tuple[str, ...] = PIPELINE_STAGES
    production: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(PRODUCTION_KEYWORDS))
    quality: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(QUALITY_KEYWORDS))
    tools: Mapping[str, str] = field(default_factory=lambda: dict(DISPLAY_TOOLS))
    whole_words: bool = False


@dataclass(frozen=True)
class JobSpec:
    """What a ranking run looks for.  Only `domains` and the three year bounds are scored."""

    role_title: str = "Senior AI Engineer"
    domains: Mapping[str, bool] = field(
        default_factory=lambda: {name: True for name in EVIDENCE_KEYWORDS})
    minimum_years: float = 3.0
    preferred_min_years: float = 5.0
    preferred_max_years: float = 12.0
    seniority_indicators: tuple[str, ...] = ("senior", "lead", "staff", "principal", "sr.", "sr")
    required_skills: tuple[str, ...] = ("Python", "Machine Learning", "Deep Learning", "NLP")
    preferred_skills: tuple[str, ...] = ("PyTorch", "Transformers", "LLMs", "Vector Databases",
                                         "MLOps", "Computer Vision", "Statistics")
    open_to_work: bool = True
    availability_days_max: int = 30
    recruiter_engagement: bool = True
    degree_preferences: tuple[str, ...] = ("B.Tech", "M.Tech", "MS", "PhD")
    field_preferences: tuple[str, ...] = ("Computer Science", "Artificial Intelligence",
                                          "Machine Learning", "Data Science", "Mathematics",
                                          "Statistics")
    preferred_locations: tuple[str, ...] = ("India", "Remote")
    relocation_preferred: bool = True


@dataclass(frozen=True)
class ScoreWeights:
    """Component weights, listed in the order in which the weighted sum is formed."""

    domain: float = 0.30
    experience: float = 0.15
    skill: float = 0.25
    education: float = 0.05
    behavioral: float = 0.10
    verification: float = 0.10
    availability: float = 0.05

    def without(self, component: str) -> "ScoreWeights":
        return replace(self, **{component: 0.0})


@dataclass(frozen=True)
class ScoreConfig:
    """Caps and slopes of the component scores."""

    evidence_cap: float = 3.0
    proficiency_cap: float = 30.0
    endorsement_cap: float = 1500.0
    proficiency_share: float = 0.7
    endorsement_share: float = 0.3
    junior_slope: float = 0.2
    senior_slope: float = 0.05
    senior_floor: float = 0.5
    blend: tuple[float, float, float] = (0.5, 0.3, 0.2)
    education_split: tuple[float, float] = (0.6, 0.4)
    unrelated_degree: float = 0.5
    tier_scores: tuple[float, float, float, float] = (1.0, 0.8, 0.6, 0.4)
    unranked_tier: float = 0.2


# Weight scenarios of the sensitivity study; A is the baseline.
SCENARIOS: dict[str, ScoreWeights] = {
    "A": ScoreWeights(),
    "B": ScoreWeights(domain=0.35, skill=0.20),
    "C": ScoreWeights(domain=0.40, skill=0.15),
}
