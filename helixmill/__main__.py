"""Command line entry."""

import sys

from helixmill.plans.api import main

sys.exit(main())
