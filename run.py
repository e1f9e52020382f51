"""Entry for spark-submit: ``spark-submit [--py-files lakeloom.zip] run.py run QUERY DATA OUT``."""

from lakeloom.__main__ import main

if __name__ == "__main__":
    main()
