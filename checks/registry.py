"""All registered queries: the reports and the jobs."""

import checks.jobs  # noqa: F401  (registers the jobs)
import checks.streams  # noqa: F401  (registers the streaming jobs)
from checks.reports import CHECKS

__all__ = ["CHECKS"]
