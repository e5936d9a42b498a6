"""`python -m loomgraph`."""

import sys

from loomgraph.cli import main

sys.exit(main())
