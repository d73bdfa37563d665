"""Prints the query names registered in some query modules (file names without suffix)."""

import re
import sys

for module in sys.argv[1:]:
    text = open(f"adsight/plans/{module}.py").read()
    print(" ".join(re.findall(r'@query\("(\w+)"\)', text)))
