import sys

from .tools import main

sys.exit(main(sys.argv[1:]))
