import sys

from lexweave.cli import main

sys.exit(main())
