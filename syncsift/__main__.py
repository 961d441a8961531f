import sys

from syncsift.cli import main

sys.exit(main(sys.argv[1:]))
