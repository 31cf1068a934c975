import sys

from tabularium.cli import main

sys.exit(main())
