from .contracts import Contract, Field, contract_from_json_schema, validate  # noqa: F401
from .readers import *  # noqa: F401,F403
from .registry import REGISTRY, SourceSpec, clean_source, load_source  # noqa: F401
from .sinks import *  # noqa: F401,F403
