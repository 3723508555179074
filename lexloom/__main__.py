import sys

from lexloom.cli import main

sys.exit(main(sys.argv[1:]))
