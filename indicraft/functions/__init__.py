from .cleaning import *  # noqa: F401,F403
from .codes import *  # noqa: F401,F403
from .geo import *  # noqa: F401,F403
from .predicates import *  # noqa: F401,F403
from .scoring import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
