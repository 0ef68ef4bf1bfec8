"""Column -> Column expressions. All JVM-side built-ins."""

from trendspark.functions.text import *  # noqa: F401,F403
from trendspark.functions.traffic import *  # noqa: F401,F403
from trendspark.functions.dates import *  # noqa: F401,F403
from trendspark.functions.urls import *  # noqa: F401,F403
from trendspark.functions.money import *  # noqa: F401,F403
