import sys

from tidewright.cli import main

sys.exit(main())
