"""Parameters of chunking, retrieval, packing and answering."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field, replace


# The defaults of the parameters are fixed values.


@dataclass(frozen=True)
class Chunking:
    max_parent: int = 1200
    max_child: int = 300
    overlap: int = 50
    min_child: int = 60
    merge_ratio: float = 1.25

    def __post_init__(self):
        if self.overlap >= self.max_child:
            raise ValueError("overlap must be smaller than max_child")

    def signature(self) -> str:
        """Changes whenever an effective parameter changes."""
        text = f"parent={self.max_parent}|child={self.max_child}|overlap={self.overlap}|min_child={self.min_child}|merge={self.merge_ratio}"
        return hashlib.sha256(text.encode()).hexdigest()[:8]


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    candidate_mul: int = 4
    min_sim: float = 0.35
    rrf_k: int = 60
    mmr_lambda: float = 0.7
    k1: float = 1.5
    b: float = 0.75
    use_bm25: bool = True
    use_mmr: bool = True

    @property
    def candidates(self) -> int:
        return self.top_k * self.candidate_mul


@dataclass(frozen=True)
class Budget:
    context: int = 6000
    system: int = 400
    history: int = 1000
    chars_per_token: float = 1.5


@dataclass(frozen=True)
class Answering:
    min_citations: int = 1
    min_vec_score: float = 0.35
    echo_blocks: int = 3
    echo_chars: int = 120


EMBED_DIM = 1536
EMBED_BATCH = 64
EMBED_RETRY = 3
EMBED_BACKOFF = 0.5
#: Dimension by name of local embedding model.  Fixed values.
LOCAL_DIMS = {"BAAI/bge-small-zh-v1.5": 512}

#: Switches of the ablation runs.  The last two are equal on purpose.
ABLATIONS = {"vector": (False, False), "bm25": (True, False), "mmr": (True, True), "full": (True, True)}
K_VALUES = (1, 3, 5, 10)
MIN_ANSWERABLE, MIN_UNANSWERABLE = 20, 5

# Fixed texts of prompts and refusals.
SYSTEM_PROMPT = "你是严谨的文档助手，请仅依据给定资料回答，并标注引用编号。"
STRICT_PROMPT = """你是严谨的文档助手。请遵守以下规则：
1. 只依据「参考资料」作答，禁止使用资料之外的知识，禁止推测或补全。
2. 每个事实性陈述后面必须标注来源编号，格式为 [1] 或 [1][2]。
3. 若参考资料不足以回答问题，直接回复「根据现有资料无法回答」，并说明还缺什么信息；不要编造。
4. 回答简洁，先给结论再给依据。"""
HISTORY_TITLE = "===== 历史对话（仅供理解指代，**不是资料**，不得作为引用来源）====="
CONTEXT_TITLE, QUESTION_TITLE = "===== 参考资料 =====", "===== 问题 ====="
NO_CONTEXT, SOURCE_LABEL = "（未检索到相关资料）", "来源："
USER_LABEL, ASSISTANT_LABEL = "用户：", "助手："
ECHO_HEADER, ECHO_NONE = "根据检索到的资料：", "根据现有资料无法回答：未检索到相关资料。"
REFUSALS = {
    "no_context": "根据现有资料无法回答：未检索到与该问题相关的文档片段。",
    "weak_support": "根据现有资料无法回答：检索到的内容与问题相关度过低，不足以支撑答案。",
    "not_supported": "根据现有资料无法回答：未能找到可支撑该结论的资料出处。",
    "invalid_citation": "根据现有资料无法回答：模型给出的引用编号不存在，答案不可信。",
    "empty_answer": "根据现有资料无法回答：模型未给出有效回答。",
    "generator_error": "生成失败：调用生成模型时发生错误，请稍后重试或检查 API 配置。",
}

#: What to do about a reason for which a file is not, or only partly, indexed.  Fixed values.
HINTS = {
    "dep_missing": "缺解析依赖（装上对应的包即可，安装命令见日志）",
    "not_implemented": "当前版本不支持该格式（请先转成 Markdown）",
    "parse_error": "文件损坏或格式不符（建议重新导出）",
    "degraded": "已降级索引（内容搜得到，但结构有损）",
}

#: Kind of document by file suffix.  Fixed values.
KINDS = {"md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html", "docx": "docx", "pdf": "pdf", "doc": "doc"}


@dataclass(frozen=True)
class Settings:
    """Everything a run is set up by."""

    backend: str = "memory"
    provider: str = "hash"
    model: str = ""
    dim: int = EMBED_DIM
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    budget: Budget = field(default_factory=Budget)
    answering: Answering = field(default_factory=Answering)

    @classmethod
    def from_env(cls, env: dict | None = None) -> Settings:
        env = os.environ if env is None else env
        backend, provider = env.get("STORE_BACKEND", "memory").lower(), env.get("EMBED_PROVIDER", "hash").lower()
        if backend not in ("memory", "pgvector"):
            raise ValueError(f"unknown store backend {backend}")
        if provider not in ("hash", "openai", "local"):
            raise ValueError(f"unknown embedding provider {provider}")
        model = env.get("EMBED_MODEL", "BAAI/bge-small-zh-v1.5" if provider == "local" else "")
        return cls(backend, provider, model, resolve_dim(provider, model, env.get("EMBED_DIM")))

    def index_signature(self, identity: str | None = None) -> str:
        return index_signature(self.chunking, identity or f"{self.provider}:{self.dim}")

    def with_retrieval(self, **changes) -> Settings:
        return replace(self, retrieval=replace(self.retrieval, **changes))


def resolve_dim(provider: str, model: str = "", explicit: str | None = None) -> int:
    """Explicit dimension, else that of a known local model, else the default; an unknown local model is an error."""
    if explicit:
        return int(explicit)
    if provider == "local":
        if model not in LOCAL_DIMS:
            raise ValueError(f"the dimension of {model!r} must be given")
        return LOCAL_DIMS[model]
    return EMBED_DIM


def index_signature(chunking: Chunking, identity: str) -> str:
    return hashlib.sha256(f"{chunking.signature()}|{identity}".encode()).hexdigest()[:8]
