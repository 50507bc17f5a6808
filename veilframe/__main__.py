import sys

from veilframe.server import main

sys.exit(main())
