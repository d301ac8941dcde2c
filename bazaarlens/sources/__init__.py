from .readers import *  # noqa: F401,F403
from .multiline import *  # noqa: F401,F403
from .writers import *  # noqa: F401,F403
from .recovery import *  # noqa: F401,F403
from .versions import *  # noqa: F401,F403
from .canonical import *  # noqa: F401,F403
from .raw import *  # noqa: F401,F403
from .shipping import *  # noqa: F401,F403
