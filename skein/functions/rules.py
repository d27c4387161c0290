"""Rule tables of extraction: names and aliases, patterns, and files' technologies. Every operator takes its own tables as well."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

#: Technologies with further names, found as whole words.
TECHNOLOGIES = {
    "fastapi": ("fast-api", "fast api"), "angular": ("ng",), "react": ("reactjs", "react.js"), "vue": ("vuejs", "vue.js"), "django": (), "flask": (),
    "express": ("expressjs", "express.js"), "nestjs": ("nest.js", "nest"), "nextjs": ("next.js", "next"), "postgresql": ("postgres", "psql", "pg"),
    "mongodb": ("mongo",), "redis": (), "elasticsearch": ("elastic", "es"), "docker": (), "kubernetes": ("k8s",), "terraform": ("tf",), "ansible": (),
    "github actions": ("gh actions",), "gitlab ci": ("gitlab-ci",), "jenkins": (), "pydantic": (), "sqlalchemy": ("sa",), "prisma": (), "typeorm": (),
    "rxjs": ("rx.js", "rx"), "ngrx": (), "langchain": (), "langgraph": (), "chromadb": ("chroma",), "lancedb": ("lance",), "pinecone": (), "ollama": (),
    "openai": ("gpt",), "anthropic": ("claude",), "huggingface": ("hf", "hugging face"), "pytorch": ("torch",), "tensorflow": ("tf",), "numpy": ("np",),
    "pandas": ("pd",), "celery": (), "rabbitmq": ("rmq",), "kafka": (), "nginx": (), "graphql": ("gql",), "grpc": (), "websockets": ("ws",),
    "starlette": (), "uvicorn": (), "pytest": (), "jest": (), "cypress": (), "playwright": (), "ruff": (), "eslint": (), "prettier": (),
}
#: Design patterns with further names, found anywhere.
PATTERNS = {
    "hexagonal architecture": ("hexagonal", "ports and adapters"), "repository pattern": ("repository",), "cqrs": ("command query responsibility segregation",),
    "event sourcing": ("event-sourcing",), "saga pattern": ("saga",), "observer pattern": ("observer",), "strategy pattern": ("strategy",),
    "factory pattern": ("factory",), "singleton pattern": ("singleton",), "dependency injection": ("di", "injection"), "middleware pattern": ("middleware",),
    "decorator pattern": ("decorator",), "adapter pattern": ("adapter",), "facade pattern": ("facade",), "react agent": ("react pattern", "react agent pattern"),
    "chain of thought": ("cot", "chain-of-thought"), "rag": ("retrieval augmented generation",), "fine-tuning": ("finetuning", "fine tuning"),
    "prompt engineering": ("prompt design",), "few-shot": ("few shot", "few-shot learning"), "zero-shot": ("zero shot",), "lora": ("low-rank adaptation",),
    "qlora": (), "microservices": ("micro-services",), "monorepo": ("mono-repo",), "domain-driven design": ("ddd",), "test-driven development": ("tdd",),
    "behavior-driven development": ("bdd",), "clean architecture": ("clean arch",), "solid principles": ("solid",),
}
#: Errors and strategies by regular expression, in any case.
ERRORS = {
    "connection error": r"connection\s*(?:error|timeout|refused|reset)",
    "timeout error": r"timeout\s*(?:error|exception)?|timed?\s*out",
    "memory error": r"out\s*of\s*memory|oom|memory\s*error",
    "import error": r"import\s*error|module\s*not\s*found",
    "type error": r"type\s*error|type\s*mismatch",
    "null pointer": r"null\s*(?:pointer|reference)|undefined\s*is\s*not",
    "race condition": r"race\s*condition|deadlock|concurrent",
    "overfitting": r"overfit(?:ting)?|over-fit",
    "underfitting": r"underfit(?:ting)?|under-fit",
    "cors error": r"cors\s*(?:error|issue|problem)",
    "authentication error": r"auth(?:entication)?\s*(?:error|fail)",
    "permission error": r"permission\s*(?:denied|error)|forbidden",
    "validation error": r"validation\s*error|invalid\s*input",
}
STRATEGIES = {
    "retry with backoff": r"retry.*backoff|exponential\s*backoff|backoff.*retry",
    "early stopping": r"early\s*stop(?:ping)?",
    "caching": r"cach(?:e|ing)\s*(?:strategy|layer|response)",
    "lazy loading": r"lazy\s*load(?:ing)?",
    "batch processing": r"batch\s*(?:process|size|ing)",
    "rate limiting": r"rate\s*limit(?:ing)?|throttl(?:e|ing)",
    "circuit breaker": r"circuit\s*breaker",
    "connection pooling": r"connection\s*pool(?:ing)?",
    "pagination": r"pagination|paginate",
    "indexing": r"(?:create|add|use)\s*index(?:es|ing)?",
    "sharding": r"shard(?:ing)?",
    "data augmentation": r"data\s*augmentation|augment\s*data",
    "learning rate scheduling": r"learning\s*rate\s*schedul",
    "gradient accumulation": r"gradient\s*accumulation",
}
#: Technologies by a file's suffix.
FILE_TECHNOLOGIES = {
    ".py": "python", ".ts": "typescript", ".js": "javascript", ".tsx": "react", ".jsx": "react", ".java": "java", ".go": "golang", ".rs": "rust",
    ".rb": "ruby", ".php": "php", ".sql": "postgresql", ".tf": "terraform", ".yml": "ansible", ".yaml": "ansible", ".dockerfile": "docker",
    ".sh": "bash", ".css": "css", ".scss": "sass", ".html": "html", ".vue": "vue", ".svelte": "svelte",
}


def load_rules(spark: SparkSession, path: str) -> dict[str, dict]:
    """Rule tables from a JSON file of {table: {name: [aliases] or pattern}}, by a path that only Spark has to read."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])
