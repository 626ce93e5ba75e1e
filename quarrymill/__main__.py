"""``python -m quarrymill``."""

import sys

from quarrymill.cli import main

sys.exit(main())
