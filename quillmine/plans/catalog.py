"""Imports every module that registers queries."""

import quillmine.plans.analysis  # noqa: F401
import quillmine.plans.code  # noqa: F401
import quillmine.plans.extended  # noqa: F401
import quillmine.plans.finders  # noqa: F401
import quillmine.plans.insights  # noqa: F401
import quillmine.plans.reference  # noqa: F401
import quillmine.plans.review  # noqa: F401
import quillmine.plans.structure  # noqa: F401
