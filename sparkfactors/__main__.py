"""python -m sparkfactors COMMAND, also by spark-submit."""

from .plans.driver import main

if __name__ == "__main__":
    raise SystemExit(main())
