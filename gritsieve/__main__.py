import sys

from gritsieve.cli import main

sys.exit(main())
