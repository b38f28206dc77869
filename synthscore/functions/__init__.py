from .scalars import *  # noqa: F401,F403
