from .scalars import *  # noqa: F401,F403
from .inference import *  # noqa: F401,F403
from .draws import *  # noqa: F401,F403
