"""A host for tests: reviews are files, and a post may fail after it has been taken."""

import json
import os
import uuid

from deltascope.sinks import posted


class FolderHost:
    def __init__(self, options):
        self.root, self.fail = options["root"], int(options.get("fail_after_posting", "0"))

    def _folder(self, repo, number):
        folder = f"{self.root}/{repo.replace('/', '_')}-{number}"
        os.makedirs(folder, exist_ok=True)
        return folder

    def posted(self, repo, number):
        folder = self._folder(repo, number)
        for name in os.listdir(folder):
            with open(f"{folder}/{name}") as file:
                yield json.load(file)["body"].split("<!-- review ")[1].split(" ")[0]

    def post(self, repo, number, payload, key):
        if repo == "down/down":
            raise OSError("refused")
        with open(f"{self._folder(repo, number)}/{uuid.uuid4().hex}.json", "w") as file:
            file.write(posted.marked(payload, key))
        flag = f"{self.root}/failed-{number}"
        if self.fail and number % self.fail == 0 and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)  # the worker dies after the host has taken the review
