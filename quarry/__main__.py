"""The command line: see quarry.api.main."""

import sys

from quarry.api import main

sys.exit(main(sys.argv[1:]))
