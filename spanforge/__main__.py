"""python -m spanforge"""

import sys

from spanforge.cli import main

sys.exit(main())
